"""Text functions. Only Unicode normalisation and HTML unescaping need Python, in Arrow batches."""

from __future__ import annotations

import html
import html.entities
import re
import string
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character ranges and stop words that results depend on.
JAPANESE = "[\\u3040-\\u30FF\\u4E00-\\u9FFF]"
KATAKANA_RUN = "([\\u30A0-\\u30FF]{2,})"
HAN_RUN = "([\\u4E00-\\u9FFF]{2,})"
STOP_WORDS = """
a an the to of and or in on for with as at by is are was were be been its it from new says say said how
what why who when after over amid into this that these those your you we our their his her will would can could may
has have had about more up out not no vs via than just now here there first last year years day week report reports
""".split()
# Words that name no topic by themselves, the part of speech that terms are made of, kinds of it that aren't.
EMPTY_NOUNS = """
こと もの ため よう これ それ あれ ここ そこ 方法 理由 発表 開始 公開 可能 登場 話題 記事 最新 必要 場合
問題 以上 以下 結果 対応 決定 判明 明らか 新た 予定 報道 利用 使用 提供 実現 実施 追加 変更 確認 指摘
存在 期待 影響 関係 関連 検討 計画 強化 拡大 向上 導入 活用 支援 展開 開発 機能 情報 世界 日本 最大
最高 規模 完全 大幅 自分 時間 時代 過去 今後 現在 全体 一部 大手 独自 正式 公式 史上 最新作 本日 同社
""".split()
NOUN, OTHER_KINDS = "名詞", ("代名詞", "非自立", "数", "接尾")
NO_LETTER = "(?U)^[\\d\\W_]+$"
LONGEST_COMPOUND = 3


#: Characters that are their own normal form wherever they stand: none composes with one before it. ASCII, Latin letters
#: and marks without compatibility forms, Cyrillic letters, kana, some of their punctuation, and Han.
SETTLED = "\\x00-\\x7F¡-§©«¬®°±¶·»¿À-ıĴ-ľŁ-ňŊ-žƀ-ǃǍ-ǰǴ-ɏЀ-ҁ、-〕ぁ-ゖァ-ヾ一-鿿"


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def nfkc(text: str | Column) -> Column:
    """The normal form; texts of settled characters alone have it already and don't go to Python."""
    text = F.col(text) if isinstance(text, str) else text
    beyond = text.rlike(f"(?=[^\\x00-\\x7F])[^{SETTLED}]")  # characters of ASCII are passed over by one comparison
    return F.coalesce(_nfkc(F.when(beyond, text)), text)


@F.arrow_udf(T.StringType())
def _unescaped(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) for t in texts.to_pylist()], pa.string())


#: The commonest entities, the ampersand last, and one that is none of them and may be an entity.
COMMON = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
OTHER_ENTITY = "&(?!(?:lt|gt|quot|#39|amp);|[\\t\\n\\f <&;])(?=.)"


def unescaped(text: str | Column) -> Column:
    """Entities as characters, as html.unescape has them. Texts with none but the commonest don't go to Python."""
    text = F.col(text) if isinstance(text, str) else text
    common = text
    for entity, character in COMMON.items():
        common = F.replace(common, F.lit(entity), F.lit(character))
    return F.coalesce(_unescaped(F.when(text.rlike(OTHER_ENTITY), text)), common)


REFERENCE = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _ended(reference: re.Match) -> str:
    said = reference[0]
    return html.unescape(said) if said[1] == "#" or said[1:] in html.entities.html5 else said


@F.arrow_udf(T.StringType())
def _ended_unescaped(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else REFERENCE.sub(_ended, t) for t in texts.to_pylist()], pa.string())


def ended_unescaped(text: Column) -> Column:
    """Entities that a semicolon ends, as characters; "&amp" cut off at the end of a title stays. Texts without any don't go to Python."""
    return F.coalesce(_ended_unescaped(F.when(text.rlike("&[#0-9A-Za-z]+;"), text)), text)


def text_of(column: str | Column) -> Column:
    """The column as text, "" for null."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def one_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)[\\s\\x1C-\\x1F]+", " "))


def plain(fragment: str | Column, gap: str = " ", decoded: Callable[[Column], Column] = unescaped) -> Column:
    """An HTML fragment as text: tags become `gap`, entities characters, white space single spaces."""
    return one_spaced(decoded(F.regexp_replace(text_of(fragment), "<[^>]+>", gap)))


def norm_name(name: str | Column) -> Column:
    """A publisher's name without width, case, spaces and separators."""
    return F.lower(F.regexp_replace(nfkc(text_of(name)), "(?U)[\\s・｜|]+", ""))


def is_japanese(text: str | Column) -> Column:
    return text_of(text).rlike(JAPANESE)


def detect_lang(text: str | Column) -> Column:
    return F.when(is_japanese(text), "ja").otherwise("en")


#: What is between two words, of which hyphens and stops at an end are no part; an s that isn't part of a word of four characters or more.
BETWEEN_WORDS = "[-.]*[^a-z0-9.\\-][^a-z0-9]*"
PLURAL = "(?<=[^ ]{2}[^ s])s(?= |$)"


def story_tokens(title: str | Column) -> Column:
    """Distinct telling tokens: ASCII words without plural s, runs of Katakana, pairs of Han characters."""
    text = F.lower(nfkc(text_of(title)))
    words = F.split(F.concat(F.lit(" "), text, F.lit(" ")), BETWEEN_WORDS)
    words = F.split(F.regexp_replace(F.array_join(F.array_distinct(words), " "), PLURAL, ""), " ")
    words = F.array_except(words, F.lit(["", *string.ascii_lowercase, *string.digits, *STOP_WORDS]))
    pairs = F.transform(
        F.regexp_extract_all(text, F.lit(HAN_RUN), 1),
        lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2))),
    )
    beyond = F.concat(F.regexp_extract_all(text, F.lit(KATAKANA_RUN), 1), F.flatten(pairs))
    return F.when(text.rlike(JAPANESE), F.array_distinct(F.concat(words, beyond))).otherwise(words)


def each_of(rows: DataFrame, items: str | Column, name: str, *kept: str | Column) -> DataFrame:
    """A row per element of an array, without the filter on the array that Spark puts below an explode, which would compute it twice."""
    return rows.select(*kept, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def telling(tokens: Column) -> Column:
    """Tokens with a letter in them."""
    return F.filter(tokens, lambda t: ~t.rlike(NO_LETTER))


def noun_terms(words: str | Column) -> Column:
    """Distinct terms of a text that a tokenizer has cut into words (surface, pos, kind): nouns, and runs of two or three of them.

    A run ends at any other word, and at a noun that is a pronoun, a number, a suffix or without a letter.
    A run of ASCII words is joined by spaces, any other without. The tokenizer is the caller's.
    """
    noun = lambda w: (w["pos"] == NOUN) & ~w["kind"].isin(*OTHER_KINDS) & ~w["surface"].rlike(NO_LETTER)
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), none.alias("run"))

    def step(state: Column, word: Column) -> Column:
        longer = F.struct(state["done"].alias("done"), F.concat(state["run"], F.array(word["surface"])).alias("run"))
        ended = F.struct(F.concat(state["done"], F.array(state["run"])).alias("done"), none.alias("run"))
        return F.when(F.coalesce(noun(word), F.lit(False)), longer).otherwise(ended)

    runs = F.aggregate(words, start, step, lambda state: F.concat(state["done"], F.array(state["run"])))
    gap = lambda run: F.when(F.forall(run, lambda s: ~s.rlike("[^\\x00-\\x7F]")), " ").otherwise("")
    joined = lambda run: F.when(F.size(run).between(2, LONGEST_COMPOUND), F.array(F.array_join(F.transform(run, lambda s: F.concat(s, gap(run))), ""))).otherwise(none)
    terms = F.flatten(F.transform(runs, lambda run: F.concat(F.filter(run, lambda s: F.length(s) > 1), F.transform(joined(run), lambda t: F.rtrim(t)))))
    return F.array_distinct(F.filter(terms, lambda t: ~t.isin(EMPTY_NOUNS)))
