import io
import tracemalloc
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import chroma

RATE = 5512


def wav(samples, rate=RATE, width=2, channels=1):
    file = io.BytesIO()
    with wave.open(file, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        wide = np.repeat(np.round(samples * 2147483392).astype("<i4"), channels).view(np.uint8).reshape(-1, 4)
        data = np.repeat((samples * 127 + 128).astype(np.uint8), channels) if width == 1 else wide[:, 4 - width :]
        f.writeframes(data.tobytes())
    return file.getvalue()


def melody(seed, notes=90):
    rng = np.random.default_rng(seed)
    return chroma.samples_of(chroma.tone_sequence(rng.normal(0, 0.2, notes).tolist(), RATE))[0]


def frames_of(samples):
    return chroma.pitch_frames(lambda first, last: samples[first:last], len(samples), RATE)


def plain_codes(frames):
    out = []
    for t in range(len(frames) - chroma.SPAN + 1):
        code = 0
        for kind, p, h, w in chroma.FILTERS:
            a = b = 0.0
            for i in range(w):
                for j in range(h):
                    inside = {"pitch": j < h // 2, "time": i < w // 2, "cross": (i < w // 2) == (j < h // 2), "middle": w // 3 <= i < w - w // 3}[kind]
                    a, b = (a + frames[t + i, p + j], b) if inside else (a, b + frames[t + i, p + j])
            value = round(float(np.log((1 + a) / (1 + b))), 9)
            code = code << 2 | [0, 1, 3, 2][sum(value > s for s in chroma.STEPS)]
        out.append(code)
    return out


def test_integral_image_matches_plain_sums():
    frames = frames_of(melody(1))
    assert chroma.packed_codes(frames).tolist() == plain_codes(frames)
    assert np.allclose(np.linalg.norm(frames, axis=1), 1)


def test_pitch_classes_of_pure_tones():
    for semitone in range(12):
        t = np.arange(RATE * 3) / RATE
        frames = frames_of(np.sin(2 * np.pi * 440 * 2 ** (semitone / 12) * t))
        assert (frames.argmax(axis=1) == semitone).all()


@pytest.mark.parametrize("audio", [None, b"", b"no wave file", wav(np.zeros(10)), wav(np.zeros(0))])
def test_what_gives_no_codes(audio):
    assert len(chroma.codes_of(audio)) == 0


def test_silence_channels_and_widths():
    assert len(set(chroma.codes_of(wav(np.zeros(RATE * 8))).tolist())) == 1
    sound = melody(3)
    one = chroma.codes_of(wav(sound))
    assert chroma.codes_of(wav(sound, channels=2)).tolist() == one.tolist()
    eight = chroma.codes_of(wav(sound, width=1))
    assert np.bitwise_count(one ^ eight).mean() < 2
    for width in (3, 4):
        assert np.bitwise_count(one ^ chroma.codes_of(wav(sound, width=width))).mean() < 0.1


def test_slices_and_cut_files_change_nothing(monkeypatch):
    sound = wav(melody(5, 200))
    whole = chroma.codes_of(sound).tolist()
    monkeypatch.setattr(chroma, "WINDOWS", 7)
    assert chroma.codes_of(sound).tolist() == whole
    cut = chroma.codes_of(sound[: len(sound) // 2]).tolist()
    assert 0 < len(cut) < len(whole) and cut == whole[: len(cut)]


@pytest.mark.parametrize("kind", ["silence", "two codes", "noise"])
def test_votes_equal_pairs(kind):
    rng = np.random.default_rng(1)
    places = {"silence": lambda n: np.arange(n), "two codes": lambda n: np.arange(0, n, 2), "noise": lambda n: np.flatnonzero(rng.random(n) < 0.3)}[kind]
    a, b = places(700), places(500)
    assert len(a) * len(b) > chroma.PAIRS
    offsets, n = chroma.votes_of(a, b)
    want = np.unique(np.subtract.outer(a, b).ravel(), return_counts=True)
    assert dict(zip(offsets.tolist(), n.tolist(), strict=True)) == dict(zip(want[0].tolist(), want[1].tolist(), strict=True))
    assert len(chroma.votes_of(np.arange(30_000), np.arange(30_000))[0]) == 59_999  # an hour of silence


def test_long_recordings_in_bounded_memory(spark):
    """Ten minutes of silence and of noise at 22 kHz; the memory of a transform is that of its windows."""
    rate, rng = 22_050, np.random.default_rng(2)
    noise = rng.normal(0, 0.1, rate * 600)
    sounds = {0: np.zeros(rate * 600), 1: np.zeros(rate * 590), 2: noise, 3: noise[rate * 30 :]}
    tracemalloc.start()
    for s in sounds.values():
        chroma.codes_of(audio := wav(s, rate))
    peak = tracemalloc.get_traced_memory()[1] - len(audio) * 8
    tracemalloc.stop()
    assert peak < 400_000_000
    docs = spark.createDataFrame([(i, wav(s, rate)) for i, s in sounds.items()], "id long, audio binary")
    members, matches = chroma.aligned_recordings(spark, docs, F.col("id") % 2 == 0, hot=1)
    assert members.count() == 4
    got = {(r.asking, r.class_id): (r.offset, r.bit_errors) for r in matches.collect()}
    assert got[0, 1] == (0, 0) and got[2, 3][1] / 32 < 0.15 * 5000 and abs(got[2, 3][0] * 2730 - 30 * rate) < 2730


def test_alignment_finds_cut_noisy_and_copied_recordings(spark):
    rng = np.random.default_rng(9)
    hop = (1 << round(np.log2(chroma.FRAME_S * RATE))) // chroma.OVERLAPS
    sounds = {i: melody(i) for i in range(0, 12)}
    rows = [(i, wav(s), "x") for i, s in sounds.items()]
    rows += [(100 + i, wav(np.clip(s[7 * hop :] + rng.normal(0, 0.01, len(s) - 7 * hop), -1, 1)), "x") for i, s in sounds.items()]
    rows += [(200, wav(sounds[4]), "copy"), (201, None, "none"), (202, b"junk", "none"), (None, wav(sounds[4]), "no id")]
    docs = spark.createDataFrame(rows, "id long, audio binary, codes string")
    members, matches = chroma.aligned_recordings(spark, docs, F.col("id") < 100)
    got = {r.id: r.class_id for r in members.collect()}
    pairs = sorted(map(tuple, matches.collect()))
    assert len(got) == len(rows) and got[200] == 4 and got[None] == 4 and got[202] == got[201] == 201
    found = sum(any(p[:3] == (got[i], 100 + i, 7) for p in pairs) for i in sounds)
    assert found >= 0.9 * len(sounds)  # recall
    assert {p[0] for p in pairs} <= set(sounds)
    again = chroma.aligned_recordings(spark, docs, F.col("id") < 100, hot=2)[1]
    assert sorted(map(tuple, again.collect())) == pairs  # integers split by class
    assert [df.count() for df in chroma.aligned_recordings(spark, docs.limit(0), F.col("id") < 100)] == [0, 0]


def plain_matches(a, b):
    """Best offset by votes of equal codes, then the overlap's bit errors; all pairs of positions."""
    votes = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if x == y:
                votes[i - j] = votes.get(i - j, 0) + 1
    if not votes:
        return None
    offset = min(votes, key=lambda o: (-votes[o], o))
    pairs = [(a[j + offset], b[j]) for j in range(len(b)) if 0 <= j + offset < len(a)]
    errors = sum(bin(int(x) ^ int(y)).count("1") for x, y in pairs)
    return (offset, len(pairs), errors) if len(pairs) >= chroma.MIN_OVERLAP and errors <= chroma.MAX_ERROR * 32 * len(pairs) else None


def test_query_matches_brute_force(spark, sf_dir):
    rows = chroma.query(spark, sf_dir).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    codes = {i: chroma.codes_of(chroma.tone_sequence(v)).tolist() for i, v in vectors.items()}
    classes = {}
    for i in sorted(codes):
        classes.setdefault(tuple(codes[i]), i)
    members = {r.vec_id: r.class_id for r in rows if r.match_class_id is None}
    assert members == {i: classes[tuple(k)] for i, k in codes.items()}
    asking = {members[i] for i in codes if i % 50 == 0}
    want = [(a, c, *m) for a in asking for k, c in classes.items() if c != a and (m := plain_matches(codes[a], list(k)))]
    assert sorted((r.class_id, r.match_class_id, r.offset, r.overlap, r.bit_errors) for r in rows if r.match_class_id is not None) == sorted(want)
