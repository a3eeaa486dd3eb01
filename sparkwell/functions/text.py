"""Text functions as column expressions: cleaning, tokens, numbers, scripts, quotes, redaction, routing."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwell.plans.views import oracle, view

# Word lists and patterns that results depend on.
STOP = ["the", "a", "an", "of", "and", "to", "in", "is", "for", "on", "with", "by"]
ROMAN_HINDI = ["hai", "kya", "kaise", "mein", "nahi", "ka", "ki", "ke", "se", "aur"]
WORD = r"[a-z0-9À-ɏ]+|[ऀ-ॿ]+"
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"


def clean(text: Column) -> Column:
    """Runs of blanks become one; lines are trimmed and blank lines dropped."""
    lines = F.transform(F.split(F.regexp_replace(text, "[ \t ]+", " "), "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def norm_for_compare(text: Column) -> Column:
    """One form for comparison: ASCII digits, plain quotes and dashes, lower case, single blanks, no edge punctuation."""
    plain = F.translate(text, "०१२३४५६७८९“”‘’–—", "0123456789\"\"''--")
    return F.regexp_replace(F.regexp_replace(F.lower(plain), r"\s+", " "), r"^[ .:;|\-_*]+|[ .:;|\-_*]+$", "")


def words(text: Column, content_only: bool = False) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*STOP)) if content_only else found


def number_tokens(text: Column) -> Column:
    """Digit groups with grouping commas removed and leading zeros trimmed."""
    found = F.regexp_extract_all(text, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(F.replace(x, F.lit(","), F.lit("")), r"^0+(?=\d)", ""))


def is_numeric_cell(text: Column) -> Column:
    digits, letters = F.length(F.regexp_replace(text, r"[^0-9]", "")), F.length(F.regexp_replace(text, r"[^A-Za-zÀ-ɏऀ-ॿ]", ""))
    return (digits > 0) & (digits >= letters)


def script_share(text: Column) -> Column:
    """Share of Devanagari among letters; 0 without letters."""
    hindi, latin = (F.length(F.regexp_replace(text, f"[^{c}]", "")) for c in ("ऀ-ॿ", "A-Za-zÀ-ɏ"))
    return F.coalesce(F.try_divide(hindi, hindi + latin), F.lit(0.0))


def language_of(text: Column) -> Column:
    share = script_share(text)
    return F.when(share > 0.7, "hi").when(share > 0.15, "mixed").otherwise("en")


def language_hint(text: Column) -> Column:
    hits = F.size(F.array_intersect(F.split(F.lower(text), r"\W+"), F.array(*map(F.lit, ROMAN_HINDI))))
    return F.when(text.rlike("[ऀ-ॿ]"), "hindi").when(hits >= 2, "hinglish")


@lru_cache(maxsize=1)
def _combining() -> dict[int, None]:
    return dict.fromkeys(c for c in range(0x110000) if unicodedata.combining(chr(c)))


def strip_accents(text: Column) -> Column:
    """The text in compatibility form without combining marks, in Arrow batches."""

    def strip(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t).translate(_combining()))

    return F.pandas_udf(strip, "string")(text)


def slug(text: Column, length: int) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(s, 1, length), "-+$", "")


def squash(text: Column) -> Column:
    """Table bars and back-ticks dropped, digit commas closed up, blanks collapsed, lower case."""
    s = F.regexp_replace(F.regexp_replace(text, "[|`]", " "), r"(\d),\s*(\d)", "$1$2")
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def quote_in(quote: Column, text: Column) -> Column:
    return F.contains(squash(text), squash(quote))


def content_overlap(claim: Column, source: Column) -> Column:
    """Share of the claim's content words that the source has; null without any."""
    a, b = F.array_distinct(words(claim, True)), F.array_distinct(words(source, True))
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(a))


def redact_pii(text: Column) -> Column:
    """Fixed placeholders, in this order: e-mail, phone, long ids."""
    s = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]")
    s = F.regexp_replace(s, r"\+[0-9]{1,3}[ ()0-9-]{7,16}[0-9]", "[PHONE]")
    return F.regexp_replace(s, r"[0-9]{12,}", "[ID]")


def dedup_key(question: Column, answer: Column) -> Column:
    form = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9À-ɏऀ-ॿ]+", " "))
    return F.concat_ws("‖", form(question), form(answer))


def family_key(category: Column, text: Column, answer: Column) -> Column:
    """Category and sorted content words; without any, a hash of the answer."""
    own = F.array_join(F.array_sort(F.array_distinct(words(text, True))), " ")
    return F.concat_ws(":", category, F.when(own != "", own).otherwise(F.substring(F.sha1(answer), 1, 8)))


def normalized_message(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), "[ ?.!।]+$", "")


def issues(text: Column) -> Column:
    """Quality codes of a text."""
    n = F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    checks = [F.when(n < 80, "thin"), F.when(F.size(F.regexp_extract_all(text, F.lit(r"\|"), F.lit(0))) >= 10, "flattened_table"), F.when(digits * 10 > F.length(text), "number_noise"), F.when(text.rlike("%%%|###|&&&"), "garbled")]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def fact_tokens(text: Column) -> Column:
    """Tokens that state facts: numbers, money, percentages, months."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[₹$€]\s?\d[\d,.]*|\d[\d,.]*\s?%|\d+|\b(?:{MONTHS})\b"), F.lit(0))


def route(text: Column, confidence: Column) -> Column:
    """Reason for the slow path, or 'local'."""
    return (
        F.when(F.length(text) > 400, "too_long").when(text.rlike("[ऀ-ॿ]"), "not_english").when(F.lower(text).rlike(r"\b(cancel|delete|remind|book)\b"), "action")
        .when(confidence < 50, "low_confidence").otherwise("local")
    )


def citation_tags(text: Column) -> Column:
    """Numbers of the sources that a text cites, each once; the first two sources if it cites none."""
    tags = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[S(\d+)\]"), F.lit(1)))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("1"), F.lit("2")))


def short_turn(text: Column) -> Column:
    return (F.length(F.trim(text)) <= 40) & ~F.contains(text, F.lit("?"))


def _docs(spark, sf_dir):
    return view(spark, sf_dir, "documents")


def _messages(spark, sf_dir):
    return view(spark, sf_dir, "messages")


def txt02_clean(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(clean(F.col("text")), 256).alias("sha"), F.length(clean(F.col("text"))).alias("n"))


def txt03_norm_for_compare(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.length(norm_for_compare(F.col("text"))).alias("n"))


def txt04_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(words(F.col("text"))).alias("n_words"), F.size(F.array_distinct(words(F.col("text"), True))).alias("n_content"))


def txt06_number_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(number_tokens(F.col("text"))).alias("number")).groupBy("doc_id", "number").agg(F.count("*").alias("n"))


def txt07_numeric_lines(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(is_numeric_cell(F.col("line"))).alias("numeric"), F.count("*").alias("lines"))


def txt08_language_of(spark, sf_dir):
    """Of all documents; every third has a greeting in Devanagari in front, as pages in two languages do."""
    s = F.concat(F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("नमस्ते दुनिया "), 40)).otherwise(F.lit("")), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.round(script_share(s), 4).alias("share"), language_of(s).alias("language"))


def txt09_language_hint(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", "turn", F.coalesce(language_hint(F.col("text")), F.lit("-")).alias("hint"))


def txt11_slug(spark, sf_dir):
    return view(spark, sf_dir, "part").select("p_partkey", slug(F.concat_ws(" ", "p_brand", "p_name", "p_type"), 20).alias("slug"))


def txt12_record_id(spark, sf_dir):
    return view(spark, sf_dir, "part").select("p_partkey", F.substring(F.sha2(F.concat_ws("\x1f", "p_brand", "p_name", F.col("p_size").cast("string")), 256), 1, 16).alias("record_id"))


def txt14_content_overlap(spark, sf_dir):
    m = _messages(spark, sf_dir)
    a = m.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    q = m.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return a.join(q, ["conv_id", "turn"]).select("conv_id", "turn", F.round(F.coalesce(content_overlap(F.col("question"), F.col("answer")), F.lit(-1.0)), 6).alias("overlap"))


def txt19_quality_audit(spark, sf_dir):
    return _docs(spark, sf_dir).select("lang", F.explode(issues(F.col("text"))).alias("issue")).groupBy("lang", "issue").agg(F.count("*").alias("n"))


def txt20_redact(spark, sf_dir):
    r = redact_pii(F.col("text"))
    count = lambda p: F.size(F.regexp_extract_all(r, F.lit(p), F.lit(0)))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(r, 256).alias("sha"), count(r"\[EMAIL\]").alias("emails"), count(r"\[PHONE\]").alias("phones"), count(r"\[ID\]").alias("ids"))


def txt21_dedup_key(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(F.sha2(dedup_key(F.col("text"), F.col("lang")), 256).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def txt22_family_key(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return m.where("role = 'user'").select("conv_id", "turn", F.sha1(family_key(F.lit("c"), F.col("text"), F.col("text"))).alias("family"))


def txt23_normalized_message(spark, sf_dir):
    return _messages(spark, sf_dir).groupBy(F.sha1(normalized_message(F.col("text"))).alias("key")).agg(F.count("*").alias("n"))


def txt27_fact_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("lang", F.size(fact_tokens(F.col("text"))).alias("k")).groupBy("lang").agg(F.sum("k").alias("tokens"), F.round(F.avg((F.col("k") > 0).cast("double")), 6).alias("leak_rate"))


def txt34_route(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return m.select("role", route(F.col("text"), F.length("text") % 100).alias("route")).groupBy("role", "route").agg(F.count("*").alias("n"))


def txt35_short_turn(spark, sf_dir):
    return _messages(spark, sf_dir).groupBy("role").agg(F.count_if(short_turn(F.col("text"))).alias("short"), F.count("*").alias("n"))


def txt38_email_valid(spark, sf_dir):
    emails = view(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lower(F.replace("c_name", F.lit("#"), F.when(F.col("c_custkey") % 3 == 0, "@").otherwise("."))), F.lit("@mail.org")).alias("email"))
    return emails.select("c_custkey", F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[a-z]{2,}$").alias("valid"))


def txt39_citations(spark, sf_dir):
    """Tags of all messages; answers cite the turns before them, two of three turns cite nothing."""
    cited = F.when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" [S"), F.col("turn").cast("string"), F.lit("] and [S10] as [S"), F.col("turn").cast("string"), F.lit("]"))).otherwise(F.col("text"))
    return _messages(spark, sf_dir).select("conv_id", "turn", F.array_join(citation_tags(cited), ",").alias("tags"))


def txt40_claims(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(F.filter(F.split("text", r"[.!?।]\s"), lambda x: F.length(F.trim(x)) > 3)).alias("claims"))


def txt18_line_repair(spark, sf_dir):
    """Lines with too many garbled tokens are dropped, the rest joined again."""
    def bad(line: Column) -> Column:
        return F.size(F.regexp_extract_all(line, F.lit("%%%|###|&&&|\\$\\$\\$"), F.lit(0)))

    def n(line: Column) -> Column:
        return F.size(F.split(line, " "))

    kept = F.filter(F.split("text", "\n"), lambda x: ~((bad(x) >= 1) & (bad(x) >= 0.12 * n(x))))
    return _docs(spark, sf_dir).select("doc_id", F.size(kept).alias("lines"), F.sha2(F.array_join(kept, "\n"), 256).alias("sha"))


def flt05_years_of_urls(spark, sf_dir):
    runs = F.filter(F.regexp_extract_all("url", F.lit(r"\d+"), F.lit(0)), lambda x: (F.length(x) == 4) & x.between("2000", "2049"))
    return view(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(F.array_distinct(runs)), ",").alias("years"))


def jsn01_payload(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return view(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.max(k).alias("most"), F.count(k).alias("n"))


def dat01_due_dates(spark, sf_dir):
    o = view(spark, sf_dir, "orders")
    return o.where(F.to_date("o_orderdate") <= F.lit("1996-06-30").cast("date")).where("o_orderstatus = 'P'").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("due"))


def dat02_retention(spark, sf_dir):
    age = (F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_timestamp("ts")) / 86400
    return view(spark, sf_dir, "turns").groupBy((age > 20).alias("expired")).agg(F.count("*").alias("n"))


def txt01_strip_accents(spark, sf_dir):
    s = strip_accents(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(s, 256).alias("sha"))


def dat03_calendar(spark, sf_dir):
    """Rows of two to four cells whose last one is short and holds a month and a digit: an order's priority, its state and its day, every fifth without a day."""
    day = F.when(F.col("o_orderkey") % 5 == 0, F.lit("not yet fixed")).otherwise(F.date_format("o_orderdate", "d MMMM yyyy"))
    line = F.concat_ws(" | ", "o_orderpriority", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderstatus")), day)
    return calendar_rows(view(spark, sf_dir, "orders").select("o_orderkey", line.alias("line")), "line").groupBy("event", "date").agg(F.count("*").alias("n"))


def calendar_rows(lines: DataFrame, line: str) -> DataFrame:
    """lines with event (first cell) and date (last cell) of those that are calendar rows."""
    cells = F.filter(F.transform(F.split(line, r"\|"), lambda x: F.trim(x)), lambda c: c != "")
    last = F.element_at("_cells", -1)
    rows = lines.withColumn("_cells", cells).where(F.size("_cells").between(2, 4))
    rows = rows.where((F.length(last) <= 60) & F.lower(last).rlike(rf"\b(?:{MONTHS})\b") & last.rlike("[0-9]"))
    return rows.withColumns({"event": F.element_at("_cells", 1), "date": last}).drop("_cells")


def fct02_faculty(spark, sf_dir):
    """Rows of five cells or more as people: links are unlinked, [at] and [dot] are written out."""
    name = F.concat(F.lit("["), F.col("c_name"), F.lit("](people/"), F.col("c_custkey").cast("string"), F.lit(")"))
    mail = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit(" [at] mail [dot] org"))
    line = F.concat_ws("|", F.lit(""), name, "c_mktsegment", F.when(F.col("c_custkey") % 4 > 0, F.col("c_nationkey").cast("string")), mail, F.lit("room 1"), F.lit(""))
    return people_rows(view(spark, sf_dir, "customer").select("c_custkey", line.alias("line")), "line").select("c_custkey", "name", "role", "email")


def people_rows(lines: DataFrame, line: str) -> DataFrame:
    """lines with name, role and email of those with five cells or more, the first with a name and one with an address."""
    plain = F.regexp_replace(F.regexp_replace(line, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"\s*\[at\]\s*", "@")
    cells = F.filter(F.transform(F.split(F.regexp_replace(plain, r"\s*\[dot\]\s*", "."), r"\|"), lambda x: F.trim(x)), lambda c: c != "")
    rows = lines.withColumn("_cells", cells).where(F.size("_cells") >= 5)
    mail = F.filter("_cells", lambda c: c.rlike(r"^[^@\s]+@[^@\s]+\.[a-z]{2,}$"))
    return rows.withColumns({"name": F.element_at("_cells", 1), "role": F.element_at("_cells", 2), "email": F.try_element_at(mail, F.lit(1))}).drop("_cells")


def tools_for(text: Column, rules: dict[str, tuple[str, ...]], always: tuple[str, ...] = ()) -> Column:
    """Names of the tools to offer for a text, sorted: those of each rule (a pattern and its tools) that the lowered text meets, and those always offered; a text that meets no rule gets all."""
    low = F.lower(text)
    every = sorted({*always, *(t for names in rules.values() for t in names)})
    wanted = {t: [p for p, names in rules.items() if t in names] for t in every}
    met = F.array(*(F.when(F.lit(True) if t in always else low.rlike("|".join(f"(?:{p})" for p in ps)), t) for t, ps in wanted.items()))
    any_rule = low.rlike("|".join(f"(?:{p})" for p in rules))
    return F.when(any_rule, F.array_compact(met)).otherwise(F.array(*map(F.lit, every)))


#: Work on a corpus: which words of a request ask for which of this library's operators.
CORPUS_TOOLS = {
    r"token|length|pack|context window": ("count_tokens", "pack_sequences"),
    r"duplicat|cop(y|ies)|same text|repeat": ("exact_dedup", "near_dedup"),
    r"personal|e-?mail|phone|address|redact": ("redact_pii",),
    r"passage|quote|evidence|cite": ("find_passages", "search"),
    r"toxic|unsafe|quality": ("score_quality", "redact_pii"),
    r"\b(search|which|where|explain)\b": ("search",),
}


def txt37_tools(spark, sf_dir):
    """Tools offered for each message: those of all rules that it meets, all of them if it meets none."""
    tools = tools_for(F.col("text"), CORPUS_TOOLS, ("ask_back",))
    return _messages(spark, sf_dir).select("conv_id", "turn", F.array_join(tools, ",").alias("tools"))


def src08_path_years(spark, sf_dir):
    """Years of each page: those stated, else those that stand in its path as numbers of four digits."""
    path = F.concat("url", F.lit("/"), F.col("page_id").cast("string"), F.lit("_"), (2010 + F.col("page_id") % 60).cast("string"), F.lit("-v2"))
    stated = F.when(F.col("page_id") % 4 == 0, F.array(F.lit("2021"), F.lit("2020")))
    return view(spark, sf_dir, "pages").select("page_id", F.array_join(years_of(stated, path), ",").alias("years"))


def years_of(stated: Column, path: Column) -> Column:
    # fixed value: years from 2000 to 2049
    return F.array_sort(F.array_distinct(F.coalesce(stated, F.regexp_extract_all(path, F.lit(r"(?<!\d)(20[0-4]\d)(?!\d)"), F.lit(1)))))


QUERIES = {n: f for n, f in list(globals().items()) if n[:3] in ("txt", "flt", "jsn", "dat", "fct", "src") and n[3:5].isdigit() and callable(f)}

_W = "regexp_extract_all(lower({0}), '[a-z0-9À-ɏ]+|[ऀ-ॿ]+')"
_STOPS = "(" + ",".join(f"'{w}'" for w in STOP) + ")"
_CW = "list_filter(" + _W + f", lambda w: length(w) > 1 and w not in {_STOPS})"
_SQ = "lower(trim(regexp_replace(regexp_replace(regexp_replace({0}, '[|`]', ' ', 'g'), '(\\d),\\s*(\\d)', '\\1\\2', 'g'), '\\s+', ' ', 'g')))"
_RED = "regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+', '[EMAIL]', 'g'), '\\+[0-9]{1,3}[ ()0-9-]{7,16}[0-9]', '[PHONE]', 'g'), '[0-9]{12,}', '[ID]', 'g')"
_CLEAN = "array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '[ \\t\\x{00a0}]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10))"
_FORM = "trim(regexp_replace(lower({0}), '[^a-z0-9À-ɏऀ-ॿ]+', ' ', 'g'))"

SQL = {
    "src08_path_years": "select page_id, case when page_id % 4 = 0 then '2020,2021' else coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(url || '/' || page_id || '_' || (2010 + page_id % 60) || '-v2', '\\d+'), lambda x: regexp_full_match(x, '20[0-4]\\d')))), ','), '') end as years from pages",
    "txt37_tools": "with r(p, t) as (values " + ", ".join(f"('{p}', {list(t)})" for p, t in CORPUS_TOOLS.items()) + "), e as (select list_sort(list_distinct(list_append(flatten(list(t)), 'ask_back'))) as every from r), h as (select conv_id, turn, list_sort(list_distinct(list_append(flatten(list(t)), 'ask_back'))) as met from conversations, r where regexp_matches(lower(text), p) group by all) select c.conv_id, c.turn, array_to_string(coalesce(h.met, every), ',') as tools from conversations c cross join e left join h using (conv_id, turn)",
    "fct02_faculty": "select c_custkey, c_name as name, c_mktsegment as role, lower(replace(c_name, '#', '.')) || '@mail.org' as email from customer where c_custkey % 4 > 0",
    "dat03_calendar": f"select event, date, count(*) as n from (select o_orderpriority as event, case when o_orderkey % 5 = 0 then 'not yet fixed' else strftime(o_orderdate, '%-d %B %Y') end as date from orders) where regexp_matches(lower(date), '\\b({MONTHS})\\b') and regexp_matches(date, '[0-9]') group by all",
    "txt01_strip_accents": "select doc_id, sha256(strip_accents(text)) as sha from documents",
    "txt02_clean": f"select doc_id, sha256({_CLEAN}) as sha, length({_CLEAN}) as n from documents",
    "txt03_norm_for_compare": "select doc_id, length(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '^[ .:;|\\-_*]+|[ .:;|\\-_*]+$', '', 'g')) as n from documents",
    "txt04_words": f"select doc_id, len({_W.format('text')}) as n_words, len(list_distinct({_CW.format('text')})) as n_content from documents",
    "txt06_number_tokens": "select doc_id, number, count(*) as n from (select doc_id, regexp_replace(replace(unnest(regexp_extract_all(text, '\\d[\\d,]*(?:\\.\\d+)?')), ',', ''), '^0+(\\d)', '\\1') as number from documents) group by all",
    "txt07_numeric_lines": "select doc_id, count(*) filter (where d > 0 and d >= l) as numeric, count(*) as lines from (select doc_id, length(regexp_replace(line, '[^0-9]', '', 'g')) as d, length(regexp_replace(line, '[^A-Za-zÀ-ɏऀ-ॿ]', '', 'g')) as l from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)) group by doc_id",
    "txt08_language_of": "select doc_id, round(s, 4) as share, case when s > 0.7 then 'hi' when s > 0.15 then 'mixed' else 'en' end as language from (select doc_id, coalesce(h / nullif(h + l, 0), 0) as s from (select doc_id, length(regexp_replace(t, '[^ऀ-ॿ]', '', 'g')) as h, length(regexp_replace(t, '[^A-Za-zÀ-ɏ]', '', 'g')) as l from (select doc_id, case when doc_id % 3 = 0 then repeat('नमस्ते दुनिया ', 40) else '' end || text as t from documents)))",
    "txt09_language_hint": "select conv_id, turn, case when regexp_matches(text, '[ऀ-ॿ]') then 'hindi' when len(list_intersect(list_distinct(string_split_regex(lower(text), '\\W+')), [" + ",".join(f"'{w}'" for w in ROMAN_HINDI) + "])) >= 2 then 'hinglish' else '-' end as hint from conversations",
    "txt11_slug": "select p_partkey, regexp_replace(substr(regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 20), '-+$', '') as slug from part",
    "txt12_record_id": "select p_partkey, substr(sha256(p_brand || chr(31) || p_name || chr(31) || cast(p_size as varchar)), 1, 16) as record_id from part",
    "txt14_content_overlap": f"select a.conv_id, a.turn, round(coalesce(len(list_intersect(list_distinct({_CW.format('q.text')}), list_distinct({_CW.format('a.text')}))) / nullif(len(list_distinct({_CW.format('q.text')})), 0), -1), 6) as overlap from conversations a join conversations q on q.conv_id = a.conv_id and q.turn + 1 = a.turn and q.role = 'user' where a.role = 'assistant'",
    "txt19_quality_audit": "select lang, issue, count(*) as n from (select lang, unnest(list_filter([case when len(regexp_extract_all(text, '\\S+')) < 80 then 'thin' end, case when len(regexp_extract_all(text, '\\|')) >= 10 then 'flattened_table' end, case when length(regexp_replace(text, '[^0-9]', '', 'g')) * 10 > length(text) then 'number_noise' end, case when regexp_matches(text, '%%%|###|&&&') then 'garbled' end], lambda x: x is not null)) as issue from documents) group by all",
    "txt20_redact": f"select doc_id, sha256(r) as sha, len(regexp_extract_all(r, '\\[EMAIL\\]')) as emails, len(regexp_extract_all(r, '\\[PHONE\\]')) as phones, len(regexp_extract_all(r, '\\[ID\\]')) as ids from (select doc_id, {_RED} as r from documents)",
    "txt21_dedup_key": f"select sha256({_FORM.format('text')} || '‖' || {_FORM.format('lang')}) as key, count(*) as n, min(doc_id) as first from documents group by all",
    "txt22_family_key": f"select conv_id, turn, sha1('c:' || case when w <> '' then w else substr(sha1(text), 1, 8) end) as family from (select *, coalesce(array_to_string(list_sort(list_distinct({_CW.format('text')})), ' '), '') as w from conversations where role = 'user')",
    "txt23_normalized_message": "select sha1(regexp_replace(regexp_replace(lower(trim(text, ' ')), '\\s+', ' ', 'g'), '[ ?.!।]+$', '')) as key, count(*) as n from conversations group by all",
    "txt27_fact_tokens": f"select lang, cast(sum(k) as bigint) as tokens, round(avg(case when k > 0 then 1.0 else 0.0 end), 6) as leak_rate from (select lang, len(regexp_extract_all(lower(text), '[₹$€]\\s?\\d[\\d,.]*|\\d[\\d,.]*\\s?%|\\d+|\\b(?:{MONTHS})\\b')) as k from documents) group by all",
    "txt34_route": "select role, case when length(text) > 400 then 'too_long' when regexp_matches(text, '[ऀ-ॿ]') then 'not_english' when regexp_matches(lower(text), '\\b(cancel|delete|remind|book)\\b') then 'action' when length(text) % 100 < 50 then 'low_confidence' else 'local' end as route, count(*) as n from conversations group by all",
    "txt35_short_turn": "select role, count(*) filter (where length(trim(text, ' ')) <= 40 and not contains(text, '?')) as short, count(*) as n from conversations group by all",
    "txt38_email_valid": "select c_custkey, c_custkey % 3 <> 0 as valid from customer",
    "txt39_citations": "select conv_id, turn, case when len(g) = 0 then '1,2' else array_to_string(list_transform(list_sort(list_transform(list_distinct(g), lambda x: {'at': list_position(g, x), 'x': x})), lambda y: y.x), ',') end as tags from (select conv_id, turn, regexp_extract_all(case when turn % 3 = 1 then text || ' [S' || turn || '] and [S10] as [S' || turn || ']' else text end, '\\[S(\\d+)\\]', 1) as g from conversations)",
    "txt40_claims": "select doc_id, len(list_filter(string_split_regex(text, '[.!?।]\\s'), lambda x: length(trim(x, ' ')) > 3)) as claims from documents",
    "txt18_line_repair": "select doc_id, len(k) as lines, sha256(coalesce(array_to_string(k, chr(10)), '')) as sha from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: not (len(regexp_extract_all(x, '%%%|###|&&&|\\$\\$\\$')) >= 1 and len(regexp_extract_all(x, '%%%|###|&&&|\\$\\$\\$')) >= 0.12 * len(string_split(x, ' ')))) as k from documents)",
    "flt05_years_of_urls": "select page_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(url, '\\d+'), lambda x: length(x) = 4 and x between '2000' and '2049'))), ','), '') as years from pages",
    "jsn01_payload": "select event_type, cast(sum(k) as bigint) as total, max(k) as most, count(k) as n from (select event_type, cast(json_extract_string(props, '$.k') as int) as k from events) group by all",
    "dat01_due_dates": "select strftime(o_orderdate, '%Y-%m') as month, count(*) as due from orders where cast(o_orderdate as date) <= date '1996-06-30' and o_orderstatus = 'P' group by all",
    "dat02_retention": oracle("select (epoch(timestamp '2024-02-01') - floor(epoch(ts))) / 86400 > 20 as expired, count(*) as n from turns group by all", "turns"),
}
