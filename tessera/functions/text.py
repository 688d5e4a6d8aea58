"""Text analysis as columns: tokenisers, stop words, stems."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The English stop words of the standard analyser (contractions included, though no token can be one).
STOP_WORDS = tuple(
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by can't cannot could couldn't "
    "did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself "
    "him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought our ours "
    "ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves then there there's these they they'd "
    "they'll they're they've this those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's "
    "whom why why's with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves".split()
)
# The stop words of the compact analyser.
COMPACT_STOP_WORDS = tuple("a an and are as at be by for from has he in is it its of on that the to was were will with or this but they have had what when where who which why how".split())
# Token patterns.
STANDARD = "[a-zA-Z0-9]+"
TECHNICAL = "0x[0-9a-fA-F]+|[a-zA-Z0-9]+(?:[-_./:][a-zA-Z0-9]+)+|[a-zA-Z0-9]+"
COMPACT = "0x[a-fA-F0-9]+|[a-zA-Z0-9]+(?:[-_:][a-zA-Z0-9]+)*"


def nonempty(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def service_tokens(text: Column, longer_than: int = 1) -> Column:
    """Lower case, other than word characters and spaces to spaces, split; duplicates stay. Null gives none."""
    cleaned = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\w\s]", " ")
    return F.filter(F.split(cleaned, r"\s+"), lambda w: F.length(w) > longer_than)


def space_tokens(text: Column, longer_than: int = 1) -> Column:
    """Lower case, trimmed, split at white space."""
    return F.filter(F.split(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"\s+"), lambda w: F.length(w) > longer_than)


def word_tokens(text: Column, longer_than: int = 2) -> Column:
    """Lower case, split at runs of other than word characters."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), lambda w: F.length(w) > longer_than)


def standard_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def simple_tokens(text: Column) -> Column:
    """Split at white space, edges stripped of other than word characters, lower case."""
    words = F.split(F.coalesce(text, F.lit("")), r"\s+")
    return nonempty(F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^\W+|\W+$", ""))))


def compact_tokens(text: Column, stop: Iterable[str] = COMPACT_STOP_WORDS) -> Column:
    """Identifiers and words; stop words go unless they hold a digit, underscore or hyphen."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({COMPACT})"), F.lit(1))
    lowered = F.transform(found, lambda w: F.lower(w))
    return F.filter(lowered, lambda w: w.rlike("[0-9_-]") | ~w.isin(*stop))


def technical_parts(raw: str) -> list[str]:
    """A technical token's terms in order: itself, then its camel-case parts, then its delimited parts (those that differ from it)."""
    camel = re.sub("([a-z0-9])([A-Z])", r"\1 \2", raw).split(" ")
    parts = [p for p in re.split("[-_./:]+", raw) if p]
    other = lambda words: [w for w in words if w and w.lower() != raw.lower()]
    return [raw, *(other(camel) if len(camel) > 1 else []), *(other(parts) if len(parts) > 1 else [])]


def placed_tokens(text: str, kind: str) -> Iterator[tuple[str, int, int]]:
    """(raw term, start, end) of a text's tokens in order."""
    for m in PATTERNS[kind].finditer(text):
        raw, start, end = m[0], m.start(), m.end()
        if kind == "simple":  # the stripped core's own offsets
            core = SURROUNDINGS.sub("", raw)
            start += len(raw) - len(LEADING.sub("", raw))
            if core:
                yield core, start, start + len(core)
        else:
            for term in technical_parts(raw) if kind == "technical" else (raw,):
                yield term, start, end


PATTERNS = {"standard": re.compile(STANDARD), "technical": re.compile(TECHNICAL), "simple": re.compile(r"\S+", re.ASCII)}
SURROUNDINGS, LEADING = re.compile(r"^\W+|\W+$", re.ASCII), re.compile(r"^\W+", re.ASCII)
#: Tokens of a batch that leaves Python.
TOKENS = 50_000


def tokenize(df: DataFrame, id_col: str, text_col: str, kind: str = "standard") -> DataFrame:
    """Rows (id, pos, term, raw_term, start_off, end_off) of every token: kind standard, technical or simple. Offsets in characters, end exclusive.

    Null and empty texts give no rows. Sub-tokens of a technical token have its offsets and positions of their own. Texts are walked in Arrow
    batches, each row by itself, so nothing is shuffled and rows that share an id keep positions of their own.
    """
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, rows = [], []

            def flush(batch=batch, owners=owners, rows=rows) -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [id_col, "pos", "raw_term", "start_off", "end_off"])
                owners.clear()
                rows.clear()
                return out

            for k, text in enumerate(batch.column(1)):
                for pos, (raw, start, end) in enumerate(placed_tokens(text.as_py() or "", kind)):
                    owners.append(k)
                    rows.append((pos, raw, start, end))
                    if len(rows) >= TOKENS:
                        yield flush()
            if rows:
                yield flush()

    if kind not in PATTERNS:
        raise ValueError(f"no such kind of tokens: {kind}")
    found = df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, pos int, raw_term string, start_off int, end_off int")
    return found.select(id_col, "pos", F.lower("raw_term").alias("term"), "raw_term", "start_off", "end_off")


# The suffix rules of Porter's algorithm (1980), steps 2 to 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """v and c by letter; y is a vowel after a consonant."""
    out = []
    for k, letter in enumerate(word):
        vowel = letter in "aeiou" or letter == "y" and k > 0 and out[-1] == "c"
        out.append("v" if vowel else "c")
    return "".join(out)


def measure(word: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    return len(re.findall("v+c+", shape(word)))


def short_ending(word: str) -> bool:
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeiouy"


def replace_first(word: str, rules, least: int) -> str:
    """The first rule whose suffix fits decides; it applies if what is left measures more than least."""
    for suffix in rules:
        if word.endswith(suffix):
            left = word[: -len(suffix)]
            return left + (rules[suffix] if isinstance(rules, dict) else "") if measure(left) > least else word
    return word


def stem(word: str) -> str:
    """Porter's stem of a word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    w = word.lower()
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and "v" in shape(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")) or not (doubled(w) and w[-1] not in "lsz") and measure(w) == 1 and short_ending(w):
                w += "e"
            elif doubled(w) and w[-1] not in "lsz":
                w = w[:-1]
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    w = replace_first(replace_first(replace_first(w, STEP2, 0), STEP3, 0), STEP4, 1)
    if w.endswith(("sion", "tion")) and measure(w[:-3]) > 1:
        w = w[:-3]
    if w.endswith("e"):
        m = measure(w[:-1])
        w = w[:-1] if m > 1 or m == 1 and not short_ending(w[:-1]) else w
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


def with_stems(tokens: DataFrame, term_col: str = "term") -> DataFrame:
    """tokens with their stems in term_col. Only distinct terms are stemmed, in Python; they are joined back."""

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(stem)

    vocabulary = tokens.select(term_col).distinct().withColumn("__stem", stems(term_col))
    return tokens.join(vocabulary, term_col).withColumn(term_col, F.col("__stem")).drop("__stem").select(*tokens.columns)


def analyze(df: DataFrame, id_col: str, text_col: str, kind: str = "standard", remove_stop_words: bool = True, stemming: bool | None = None, stop: Iterable[str] = STOP_WORDS) -> DataFrame:
    """Analysed tokens as `tokenize` gives them; positions keep the gaps of removed words.

    standard: stop words go, the rest is stemmed. technical: the same for plain words, stems only if asked; terms with a digit or
    one of _-./: pass. simple: neither.
    """
    tokens = tokenize(df, id_col, text_col, kind)
    if kind == "simple":
        return tokens
    passes = F.col("term").rlike(r"[0-9_\-./:]") if kind == "technical" else F.lit(False)
    if remove_stop_words:
        tokens = tokens.where(passes | ~F.col("term").isin(*stop))
    if stemming is None:
        stemming = kind == "standard"
    if not stemming:
        return tokens
    return with_stems(tokens) if kind == "standard" else with_stems(tokens.where(~passes)).unionByName(tokens.where(passes))
