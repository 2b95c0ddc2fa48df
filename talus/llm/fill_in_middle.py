"""Fill-in-middle transformation over numpy code points, and its inverse.

Each text is decoded to an array of 32-bit code points and each code point gets a class.  Comparing
neighbouring classes gives the borders of units (`flatnonzero`); two border ranks drawn from a digest
of the id cut the text into prefix, middle and suffix, which are sliced and encoded again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import documents, give_back, keyed_text, slices

FORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
#: Sentinels before prefix, suffix and middle (fixed values of the contract).
SENTINELS = ("<P>", "<S>", "<M>")
#: Texts of an Arrow step, in bytes: code points take four bytes a character besides.
STEP = 2 << 20

_BLANK = np.zeros(0x110000, bool)
_BLANK[[c for c in range(0x3001) if chr(c).isspace()]] = True


@dataclass(frozen=True)
class Rules:
    """Unit of the cuts (`line`, `word` or `char`), share of texts that are cut, share of them in suffix-first form, seed."""

    unit: str = "line"
    rate: int = 100
    spm: int = 50
    seed: int = 7

    def draws(self, doc_id: int | None) -> list[int]:
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(digest[a : a + 8], 16) for a in range(0, 32, 8)]


def borders(codes: np.ndarray, unit: str) -> np.ndarray:
    """Positions at which units end; the last is the length, and an empty text has none.

    A line ends after its line feed; a word is a run of blanks or of other characters.
    """
    if not len(codes):
        return np.empty(0, np.int64)
    if unit == "line":
        feed = codes == 10
        inner = np.flatnonzero(feed[:-1]) + 1
    elif unit == "word":
        blank = _BLANK[codes]
        inner = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    elif unit == "char":
        inner = np.arange(1, len(codes))
    else:
        raise ValueError(f"no such unit: {unit}")
    return np.append(inner, len(codes))


def transform(doc_id: int | None, text: str, rules: Rules) -> tuple:
    """Number of units, form, characters of prefix and of middle (none if plain), and output."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = borders(codes, rules.unit)
    n = len(ends)
    h1, h2, h3, h4 = rules.draws(doc_id)
    if not n or any(s in text for s in SENTINELS) or h3 % 100 >= rules.rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (low, high))
    prefix, middle, suffix = (codes[x:y].tobytes().decode("utf-32-le") for x, y in ((0, a), (a, b), (b, len(codes))))
    p, s, m = SENTINELS
    if h4 % 100 < rules.spm:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Every text in its form: `doc_id, n, form, prefix_chars, middle_chars, output`.

    One row per input row: null text is empty, empty texts and those that hold a sentinel stay plain
    with null lengths; cuts follow from the id alone, so rows that share an id draw alike, and a null
    id draws as an empty one; an empty table gives none; other columns are ignored.  No row moves.
    """

    def run(batches):
        for batch in slices(batches, limit=STEP):
            got = [transform(i, t, rules) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            n, form, prefix, middle, output = zip(*got)
            long = pa.int64()
            columns = [batch.column(0), pa.array(n, long), pa.array(form, pa.string()), pa.array(prefix, long), pa.array(middle, long), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
        give_back()

    return keyed_text(docs).mapInArrow(run, FORMED)


def restored(output: str = "output", form: str = "form"):
    """The text rebuilt from output and form alone, as a column.

    A cut text holds no sentinel, and none arises where a part meets one, since no sentinel's end is the
    beginning of another: the first occurrence of each is the right one.
    """
    p, s, m = SENTINELS
    text = F.col(output)

    def parts(first: str, second: str, third: str):
        body = F.substr(text, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, third, 1)
        return one, two, F.substr(rest, F.length(two) + len(third) + 1)

    prefix, suffix, middle = parts(p, s, m)
    suffix_, prefix_, middle_ = parts(s, p, m)
    return (
        F.when(F.col(form) == "psm", F.concat(prefix, middle, suffix))
        .when(F.col(form) == "spm", F.concat(prefix_, middle_, suffix_))
        .otherwise(text)
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    formed = fill_in_middle(documents(spark, sf_dir))
    return formed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"),
    )


ORACLE = r"""
with texts as (
  select doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as units, sha256('7:' || doc_id) as digest
  from documents
), drawn as (
  select doc_id, text, units, len(units) as n,
         cast('0x' || digest[1:8] as bigint) as h1, cast('0x' || digest[9:16] as bigint) as h2,
         cast('0x' || digest[17:24] as bigint) as h3, cast('0x' || digest[25:32] as bigint) as h4
  from texts
), cut as (
  select doc_id, text, units, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100
              then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from drawn
), parts as (
  select doc_id, text, n, form, array_to_string(units[1:a], '') as prefix,
         array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix
  from cut
)
select doc_id, cast(n as bigint) as n, form,
       case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars,
       case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
       sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                        else text end) as output_sha256,
       sha256(text) as restored_sha256
from parts
"""

QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
ORACLES = {"op12_fill_in_middle": ORACLE}
