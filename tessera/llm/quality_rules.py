"""Quality rules as a bitmask ledger.

`measure` evaluates every rule once over whole texts: measurements as columns, failures as bits of one long. A policy
is a named, versioned set of rule bits; `apply_policy` is then one bitwise AND, and `ablate` finds with bitwise counts
what each rule removes alone, without reading a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, words

#: The rules by bit; each is a condition under which a document fails, over the measurements of `measure`.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 35 * n_lines",
    "shouting": "100 * n_upper_words > 30 * n_words",
    "exclamations": "100 * n_exclamations > 20 * n_words",
    "stuttering": "100 * n_stutter_words > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


#: few_words and repeated_windows as every policy has them.
BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STRICT = Policy("strict", 1, tuple(RULES))
LENIENT = Policy("lenient", 1, ("few_words", "repeated_windows", "symbols", "duplicate_lines"))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_exclamations", "n_stutter_words")
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"


def measurements(text: str | None, window: int = 5) -> tuple[int, ...]:
    """MEASURES of one text (None: empty)."""
    text = text or ""
    found = words(text)
    n = len(found)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    repeated = 0
    if n > window:
        grams = list(zip(*(found[k:] for k in range(window)), strict=False))
        if len(set(grams)) < len(grams):
            first, covered = {}, bytearray(n)
            for k, gram in enumerate(grams):
                j = first.setdefault(gram, k)
                if j != k:
                    covered[k : k + window] = covered[j : j + window] = b"\1" * window
            repeated = sum(covered)
    return (
        n,
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        sum(map(bytes.isupper, found)),
        text.count("!"),
        sum(map(bytes.__eq__, found, found[1:])),
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 5) -> DataFrame:
    """The ledger: one row a document with its MEASURES (longs over the whole text) and `failures`, the bits of RULES that it fails.

    A null text counts as empty (all measures 0; few_words fails). Null and repeated ids pass through, a row each; an
    empty table gives none; other columns are ignored. n_lines and n_dup_lines regard lines with a word only.
    """

    def per_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(zip(*(measurements(t, window) for t in batch.column(1).to_pylist()), strict=True))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], [id_col, *MEASURES])

    chosen = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES)
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES.items()]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return map_arrow(chosen, per_slice, schema).withColumn("failures", failures)


def fails(policy: Policy, failures: str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(ledger: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with `kept`: true if no rule of the policy fails."""
    return ledger.withColumn("kept", ~fails(policy))


def ablate(ledger: DataFrame, policy: Policy) -> DataFrame:
    """A row for each rule of the policy: documents that fail it, that only it removes, and that the policy keeps without it. One pass, partial sums."""
    masked = F.col("failures").bitwiseAND(F.lit(policy.mask).cast("long"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum((masked == 0).cast("long")).alias("kept")]
    for r in policy.rules:
        sums += [F.sum((masked.bitwiseAND(F.lit(BIT[r]).cast("long")) != 0).cast("long")).alias(f"fail_{r}"), F.sum((masked == F.lit(BIT[r]).cast("long")).cast("long")).alias(f"only_{r}")]
    rows = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.coalesce(f"fail_{r}", F.lit(0)).alias("n_failed"), F.coalesce(f"only_{r}", F.lit(0)).alias("n_only"), F.coalesce(F.col("kept") + F.col(f"only_{r}"), F.lit(0)).alias("n_kept_without")) for r in policy.rules)))
    return ledger.agg(*sums).select(rows.alias("r")).select(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "r.*")
