"""Fill-in-middle: documents cut in three at drawn places and written in another order, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import load, per_batch, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Runs:
    """A text as maximal runs of letters and of other characters; a run of letters is one unit, any other character one.

    Kept are where each run starts and how many units come before it, one number each for a run, so that the character
    at which a unit starts is found by halving the runs and by arithmetic within one.
    """

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        letters = ((codes | np.uint32(32)) - np.uint32(97)) < 26
        self.starts = np.concatenate([np.zeros(min(1, len(codes)), np.int64), np.flatnonzero(letters[1:] != letters[:-1]) + 1])
        self.letters = letters[self.starts]
        lengths = np.diff(np.append(self.starts, len(codes)))
        self.ends = np.cumsum(np.where(self.letters, 1, lengths))
        self.units, self.chars = int(self.ends[-1]) if len(codes) else 0, len(codes)

    def character(self, units: int) -> int:
        """How many characters the first ``units`` units have."""
        if units >= self.units:
            return self.chars
        run = int(np.searchsorted(self.ends, units, "right"))
        before = int(self.ends[run - 1]) if run else 0
        return int(self.starts[run]) + (0 if self.letters[run] else units - before)


def draws(key: Column, seed: int) -> Column:
    """Four numbers below 2^32 drawn for a key: the first groups of eight digits of a hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def cut(fim_percent: int, spm_percent: int):
    def work():
        def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = []
            for text, (h1, h2, h3, h4) in zip(batch.column("text").to_pylist(), batch.column("drawn").to_pylist(), strict=True):
                runs = Runs(text)
                if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= fim_percent:
                    rows.append((runs.units, "plain", None, None, text))
                    continue
                first, last = sorted((h1 % (runs.units + 1), h2 % (runs.units + 1)))
                a, b = runs.character(first), runs.character(last)
                head, middle, tail = text[:a], text[a:b], text[b:]
                if h4 % 100 < spm_percent:
                    rows.append((runs.units, "spm", a, b - a, f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{middle}"))
                else:
                    rows.append((runs.units, "psm", a, b - a, f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{middle}"))
            n, form, prefix, middle, output = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

        return one

    return per_batch(work)


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """One row per row of ``docs``: id, n, form, prefix_chars, middle_chars, output.

    ``n`` counts the text's units, each a run of ASCII letters or one other character. Two cuts between units, drawn from
    seed and id, part it into prefix, middle and suffix; ``output`` is the text (plain), or the parts with their marks as
    prefix, suffix, middle (psm) or suffix, prefix, middle (spm). Texts that are empty or hold a mark stay plain; null
    texts are empty ones. A null id draws as an empty string. Rows that repeat an id and its text give equal rows. Other
    columns aren't looked at. An empty table gives an empty table. Each row stands for itself: nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), draws(F.col(id_col), seed).alias("drawn"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(cut(fim_percent, spm_percent), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from. Marks can't overlap, so each is where it was put."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(load(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
numbers AS (SELECT *, len(u)::BIGINT AS n, list_transform(range(0, 4), lambda i: ('0x' || substring(h, 1 + 8 * i::BIGINT, 8))::BIGINT) AS d FROM drawn),
cuts AS (
    SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= 90 THEN 'plain' WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (SELECT *, array_to_string(u[:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""
