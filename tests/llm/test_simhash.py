import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from newsloom.llm import simhash


def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=2):
    label = {f: f for f in fps}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= distance:
                label[max(top(a), top(b))] = min(top(a), top(b))
    return {f: top(f) for f in fps}


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "Two Words", "A b c", "À É x y Z à é", "a b c " * 500, "x " * 70000])
def test_fingerprint_matches_plain_form(text):
    assert simhash.fingerprint(text, 3) == plain_fingerprint(text)


def near_family(seed, centres, members, flips):
    rng = np.random.default_rng(seed)
    out = set()
    for c in rng.integers(-(2**63), 2**63, centres):
        for _ in range(members):
            mask = 0
            for b in rng.integers(0, 64, rng.integers(0, flips + 1)):
                mask ^= 1 << int(b)
            out.add(int(np.array(int(c) & (2**64 - 1) ^ mask, np.uint64).view(np.int64)))
    return sorted(out)


@pytest.mark.parametrize("group", [2048, 3])
@pytest.mark.parametrize("distance", [1, 2, 3])
def test_links_and_components_match_brute_force(spark, monkeypatch, group, distance):
    if group == 3:
        monkeypatch.setattr(simhash, "posting_stars", small_group(group))
    fps = near_family(1, 12, 40, 4) + [0, -1, 1, 3, 7, 15]
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    monkeypatch.setattr(simhash, "GROUP", group)  # of 3: postings are posted again
    roots = {r.node: r.root for r in simhash.components(spark, simhash.star_edges(spark, frame, distance)).collect()}
    want = plain_components(fps, distance)
    assert {f: roots.get(f, f) for f in fps} == want


def small_group(group):
    """posting_stars with its bound set in the worker."""
    whole = simhash.posting_stars

    def stars(members, distance):
        simhash.GROUP = group
        return whole(members, distance)

    return stars


def test_every_linked_pair_meets_in_a_posting():
    rng = np.random.default_rng(2)
    for distance in range(1, 5):
        masks = [simhash.mask_of(p) for p in simhash.posted_positions(distance)]
        for _ in range(500):
            flip = 0
            for b in rng.choice(64, distance, replace=False):
                flip |= 1 << int(b)
            differ = int(np.array(flip, np.uint64).view(np.int64))
            assert any(differ & m == 0 for m in masks)
            for positions in simhash.posted_positions(distance):
                if differ & simhash.mask_of(positions) == 0:
                    assert any(differ & simhash.mask_of(n) == 0 for n in simhash.narrower_positions(positions, distance))


def test_the_tally_rejects_pairs_and_bits_verify_the_rest():
    """Of the pairs that meet, the tally rejects those with too few shared bytes, the bits some of those retained."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**32, 300).astype(np.int64) << 32  # one posting: the four lower bytes are shared
    near = base[:40] ^ (np.int64(1) << rng.integers(32, 64, 40))
    far = base[40:80] ^ (np.int64(255) << 40)  # one byte differs, in all its bits
    members = np.unique(np.concatenate((base, near, far)))
    met = len(members) * (len(members) - 1) // 2
    first, second, retained = simhash.tallied(members, 2)
    pairs = [(i, j, int(members[i] ^ members[j])) for i in range(len(members)) for j in range(i + 1, len(members))]
    shared = [(i, j, x) for i, j, x in pairs if sum((x >> 8 * p & 255) == 0 for p in range(8)) >= 6]
    linked = {(i, j) for i, j, x in shared if (x & (2**64 - 1)).bit_count() <= 2}
    assert retained == len(shared) and set(zip(first.tolist(), second.tolist(), strict=True)) == linked
    assert met > 100 * retained and retained > len(linked) >= 40


def test_lookups_equal_the_tally():
    rng = np.random.default_rng(5)
    members = np.unique(rng.integers(0, 1 << 16, 1500)).astype(np.int64) << 24 | 7
    for distance in (1, 2):
        pairs = [set(zip(*(x.tolist() for x in found[:2]), strict=True)) for found in (simhash.tallied(members, distance), simhash.looked_up(members, distance))]
        assert pairs[0] == pairs[1] and pairs[0]


def test_null_empty_long_tied_and_extra_columns(spark):
    rows = [(7, None, "x", 1), (3, "", "y", 2), (9, " ", "z", 3), (4, "a b c d " * 9000, None, 4), (4, "a b c d " * 9000, None, 4), (None, "q w e r t", "u", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = sorted(map(tuple, simhash.near_duplicate_groups(spark, docs).select("id", "component_id").collect()), key=str)
    assert got == sorted([(7, 3), (3, 3), (9, 3), (4, 4), (4, 4), (None, None)], key=str)
    assert simhash.near_duplicate_groups(spark, docs.limit(0)).count() == 0


def test_query_matches_brute_force(spark, sf_dir):
    docs = [(r.doc_id, plain_fingerprint(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    roots = plain_components(sorted({f for _, f in docs}))
    least = {}
    for d, f in docs:
        least[roots[f]] = min(d, least.get(roots[f], d))
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.query(spark, sf_dir).collect()}
    assert got == {(d, f"{f:016x}", least[roots[f]]) for d, f in docs}
    assert simhash.query(spark, sf_dir).where(F.col("component_id") > F.col("doc_id")).count() == 0
