"""Operator 11: fill-in-the-middle arrangements of whole texts, in Spark SQL alone.

regexp_extract_all cuts a text into units (lines with their line feed). conv over substrings of one
sha2 of seed and id gives four numbers: the first two cut the units, the third decides whether the text
is rearranged, the fourth in which order. slice and array_join build prefix, middle and suffix, and
sentinels join them. restored() finds the sentinels in an output and puts the parts back in order.
No row is moved.

Sentinels begin with a character that they have nowhere else, so that no part and sentinel can form a
further one where they meet: a text without sentinels is restored exactly.

Defined cases: null or empty text is one plain text without units; a text that has a sentinel stays
plain; a null doc_id is hashed as the empty string; repeated rows give repeated results; an empty table
gives an empty result; other columns stay in transform() and are ignored by the query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.llm.common import table, text_of

#: A line with its line feed, or the rest of the text.
LINES = r"[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Arrangement:
    """seed of the hashes; rate and spm: shares (of 100) of texts that are rearranged, and of those in the order suffix, prefix, middle."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    units: str = LINES

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if len({*marks}) < 3 or len({m[:1] for m in marks}) > 1 or any(not m or m[0] in m[1:] for m in marks):
            raise ValueError("sentinels differ, and begin with one character that they have nowhere else")


def _numbers(seed: int, doc_id: Column) -> Column:
    """The first four 8-digit groups of the hash of seed and id, as an array."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.transform(F.array(digest), lambda h: F.array(*(F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4))))[0]


def transform(docs: DataFrame, how: Arrangement = Arrangement()) -> DataFrame:
    """docs with n_units, form (plain, psm or spm), prefix_chars, middle_chars (code points, null if plain) and arranged (the output text)."""
    text, names = text_of(), docs.columns
    cut = docs.select(*(F.col(f"`{c}`") for c in names), text.alias("_fim_text"), F.regexp_extract_all(text, F.lit(how.units), F.lit(0)).alias("_fim_units"), _numbers(how.seed, F.col("doc_id")).alias("_fim_h"))
    n, h = F.size("_fim_units"), F.col("_fim_h")
    first, second = (F.pmod(h[k], n.cast("long") + 1).cast("int") for k in range(2))
    marked = F.contains("_fim_text", F.lit(how.prefix)) | F.contains("_fim_text", F.lit(how.suffix)) | F.contains("_fim_text", F.lit(how.middle))
    form = F.when((F.col("_fim_text") == "") | marked | (h[2] % 100 >= how.rate), "plain").when(h[3] % 100 < how.spm, "spm").otherwise("psm")
    cut = cut.select("*", F.least(first, second).alias("_fim_lo"), F.greatest(first, second).alias("_fim_hi"), form.alias("_fim_form"))

    def part(begin: Column, end: Column) -> Column:
        return F.array_join(F.slice("_fim_units", begin + 1, end - begin), "")

    lo, hi = F.col("_fim_lo"), F.col("_fim_hi")
    parts = F.when(F.col("_fim_form") != "plain", F.struct(part(F.lit(0), lo).alias("p"), part(lo, hi).alias("m"), part(hi, n).alias("s")))
    cut = cut.select(*(F.col(f"`{c}`") for c in names), n.cast("long").alias("n_units"), F.col("_fim_form").alias("form"), "_fim_text", parts.alias("_fim"))
    p, m, s = (F.col("_fim")[k] for k in "pms")
    arranged = F.when(F.col("form") == "psm", F.concat(F.lit(how.prefix), p, F.lit(how.suffix), s, F.lit(how.middle), m)).when(F.col("form") == "spm", F.concat(F.lit(how.suffix), s, F.lit(how.prefix), p, F.lit(how.middle), m)).otherwise(F.col("_fim_text"))
    own = [F.col(f"`{c}`") for c in names if c not in ("n_units", "form", "prefix_chars", "middle_chars", "arranged")]
    return cut.select(*own, F.col("n_units"), "form", F.length(p).cast("long").alias("prefix_chars"), F.length(m).cast("long").alias("middle_chars"), arranged.alias("arranged"))


def restored(arranged: Column, form: Column, how: Arrangement = Arrangement()) -> Column:
    """The text that an output of transform() was made of, from the output and its form alone."""
    middle = F.split_part(arranged, F.lit(how.middle), F.lit(2))
    before = F.split_part(arranged, F.lit(how.middle), F.lit(1))
    inner = F.when(form == "psm", F.lit(how.suffix)).otherwise(F.lit(how.prefix))
    outer = F.when(form == "psm", F.lit(how.prefix)).otherwise(F.lit(how.suffix))
    one = F.split_part(F.split_part(before, outer, F.lit(2)), inner, F.lit(1))  # what stands first
    two = F.split_part(before, inner, F.lit(2))
    return F.when(form == "psm", F.concat(one, middle, two)).when(form == "spm", F.concat(two, middle, one)).otherwise(arranged)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return done.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
        digest(F.col("arranged")).alias("output_sha256"), digest(restored(F.col("arranged"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as units,
             cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from d),
c as (select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as lo, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as hi,
             case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from u),
p as (select *, array_to_string(units[1:lo], '') as p, array_to_string(units[lo + 1:hi], '') as m, array_to_string(units[hi + 1:], '') as s from c)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else t end) as output_sha256,
       sha256(t) as restored_sha256
from p
"""
