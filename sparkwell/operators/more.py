"""The rest of the inventory: joins by containment and ranges, tables in text, questions and policies, case scores, work lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwell.functions.text import words
from sparkwell.operators.retrieval import RRF, SERVABLE
from sparkwell.plans.views import oracle, view
from sparkwell.sources.corpus import lines_of

# Number words of the Indian system.
_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


_BELOW_100 = [*_SMALL, *(f"{t} {u}".removesuffix(" zero") for t in _TENS for u in _SMALL[:10])]


def in_words(number: Column) -> Column:
    """A whole number in words: two digits at a time are looked up, groups of hundred, thousand, lakh and crore joined; the crores, up to 99,99,999, are groups themselves."""
    names = F.array(*map(F.lit, _BELOW_100))

    def groups(n: Column) -> Column:
        parts = [(n.cast("long") % size / unit, name) for name, size, unit in (("lakh", 10_000_000, 100_000), ("thousand", 100_000, 1000), ("hundred", 1000, 100), ("", 100, 1))]
        said = [(F.floor(k).cast("int"), name) for k, name in parts]
        return F.concat_ws(" ", *(F.when(k > 0, F.concat_ws(" ", F.element_at(names, k + 1), F.lit(name) if name else F.lit(None).cast("string"))) for k, name in said))

    size = F.abs(number.cast("long"))
    crores = F.floor(size / 10_000_000)
    words_ = F.concat_ws(" ", F.when(number < 0, "minus"), F.when(crores > 0, F.concat_ws(" ", groups(crores), F.lit("crore"))), F.when(size % 10_000_000 > 0, groups(size)))
    return F.when(number == 0, "zero").when(number.isNotNull(), words_)


def sentences(text: Column) -> Column:
    """Parts after . ! ? or danda, where a capital or Devanagari follows."""
    return F.filter(F.split(text, r"(?<=[.!?।॥])\s+(?=[A-ZÀ-Þऀ-ॿ])"), lambda x: F.trim(x) != "")


def has_keyword(text: Column, keywords: Iterable[str]) -> Column:
    """Any of the keywords as a whole word."""
    return F.lower(text).rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(keywords)})(?![\p{{L}}\p{{N}}_])")


def cells_of(lines: DataFrame) -> DataFrame:
    """doc_id, pos, col, cell of lines with bars."""
    rows = lines.where(F.contains("line", F.lit("|")))
    return rows.select("doc_id", "pos", F.posexplode(F.transform(F.split("line", r"\|"), lambda x: F.trim(x))).alias("col", "cell"))


def rank_filters(question: Column) -> dict[str, Column]:
    """Year, round, programme, seat category, authority, quota, gender, PwD and basis of a question; each only if it names exactly one."""
    one = lambda p: F.when(F.size(x := F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit(p), F.lit(1)))) == 1, x[0])
    patterns = {
        "year": r"\b((?:19[89]|20[0-4])\d)\b", "round": r"\bround (\d)\b", "programme": r"\b(programme-\d+)\b", "seat_category": r"\b(category-\d+)\b",
        "authority": r"\b(authority-\d+)\b", "quota": r"\bquota ([a-z])\b", "gender": r"\b(women|men)\b", "pwd": r"\b(pwd)\b", "basis": r"\b(opening|closing)\b",
    }
    return {n: one(p) for n, p in patterns.items()}


def follow_up(before: Column, now: Column) -> Column:
    """The question before with the category or the round of a follow-up that names only that; else the question as it stands."""
    cat, rnd = F.regexp_extract(now, r"(category-\d+)", 1), F.regexp_extract(now, r"(round \d+)", 1)
    only_cat, only_rnd = (cat != "") & (rnd == "") & before.rlike(r"category-\d+"), (rnd != "") & (cat == "") & before.rlike(r"round \d+")
    return F.when(only_cat, F.regexp_replace(before, F.lit(r"category-\d+"), cat)).when(only_rnd, F.regexp_replace(before, F.lit(r"round \d+"), rnd)).otherwise(now)


def score_cases(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """case_id, rr, pass1, pass3, found: the first hit of each case that is of an expected source."""
    good = hits.join(cases, "case_id").where(F.array_contains("expected", F.col("source")))
    first = good.groupBy("case_id").agg(F.min("rank").alias("first"))
    return cases.join(first, "case_id", "left").select("case_id", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.coalesce(F.col("first") == 1, F.lit(False)).alias("pass1"), F.coalesce(F.col("first") <= 3, F.lit(False)).alias("pass3"), F.col("first").isNotNull().alias("found"))


def bind_policy(questions: DataFrame, rules: DataFrame) -> DataFrame:
    """The first rule, in order, whose pattern a question matches and whose exclusion it does not."""
    hit = questions.join(F.broadcast(rules), F.expr("rlike(lower(text), pattern) and not rlike(lower(text), exclude)"))  # rules are a configuration of a few rows
    return hit.groupBy("item_id").agg(F.min(F.struct("order", "rule")).alias("m")).select("item_id", F.col("m.rule").alias("rule"))


def legacy_fuse(channels: DataFrame) -> DataFrame:
    """item_id, key, score: reciprocal ranks summed over channels by the passage's own text."""
    return channels.groupBy("item_id", "key").agg(F.round(F.sum(1 / (RRF + F.col("rank"))), 8).alias("score"))


def assemble(facts: DataFrame, ranked: DataFrame, related: DataFrame, k: int) -> DataFrame:
    """item_id, doc_id, position: facts first, then ranked up to k, then related up to k + 2; each document once."""
    parts = [df.select("item_id", "doc_id", F.lit(s).alias("section"), "rank") for s, df in enumerate((facts, ranked, related))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    once = both.withColumn("n", F.row_number().over(W.partitionBy("item_id", "doc_id").orderBy("section", "rank"))).where("n = 1")
    placed = once.withColumn("position", F.row_number().over(W.partitionBy("item_id").orderBy("section", "rank", "doc_id")))
    return placed.where((F.col("position") <= k) | (F.col("section") == 2) & (F.col("position") <= k + 2)).select("item_id", "doc_id", "section", "position")


def _docs(spark, sf_dir):
    return view(spark, sf_dir, "documents")


def _turns(spark, sf_dir):
    return view(spark, sf_dir, "turns")


def jn03_overlay(spark, sf_dir):
    extras = view(spark, sf_dir, "blocks").where("status = 'approved'").groupBy("source_id", "page_start").agg(F.max("n_chars").alias("extra"))
    return view(spark, sf_dir, "blocks").join(extras, ["source_id", "page_start"], "left").groupBy("source_id").agg(F.count("extra").alias("overlaid"), F.count("*").alias("n"))


def jn09_page_range(spark, sf_dir):
    """Curated facts name a source by its first letters and a page; blocks cover ranges of pages. Facts of one length of prefix are found by it, then the page decides."""
    b = view(spark, sf_dir, "blocks")
    facts = b.where("status = 'approved'").select(F.substring("source_id", 1, 4).alias("prefix"), F.col("page_start").alias("page")).distinct()
    found = b.withColumn("prefix", F.substring("source_id", 1, 4)).join(facts, "prefix").where("page between page_start and page_end")
    return found.groupBy("prefix", "page").agg(F.count("*").alias("blocks"), F.min("block_id").alias("first"))


def jn11_unit_parents(spark, sf_dir):
    units = view(spark, sf_dir, "blocks").select("block_id", F.explode(F.array(F.col("block_id") - F.col("block_id") % 3, F.col("block_id"))).alias("parent"))
    p = view(spark, sf_dir, "blocks").select(F.col("block_id").alias("parent"), "status")
    return units.distinct().join(p, "parent").groupBy("status").agg(F.count("*").alias("units"), F.countDistinct("parent").alias("parents"))


def jn14_family_overlap(spark, sf_dir):
    t = _turns(spark, sf_dir).withColumn("split", F.when(F.col("turn_id") < 500, "train").otherwise("test"))
    return t.groupBy("session_id").agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def jn16_owned_keys(spark, sf_dir):
    t = _turns(spark, sf_dir).select("session_id", F.concat_ws("|", "status", "model_calls").alias("key"))
    owned = t.where("session_id < 3").select("key").distinct()
    return t.join(owned, "key", "left_semi").groupBy("key").agg(F.countDistinct("session_id").alias("owners"))


def agg07_recall(spark, sf_dir):
    t = _turns(spark, sf_dir).withColumn("answerable", F.col("status") != "error")
    return t.groupBy("model_calls").agg(F.round(F.try_divide(F.count_if(F.col("answerable") & (F.col("seconds") < 90)), F.greatest(F.lit(1), F.count_if("answerable"))), 4).alias("recall"))


def agg08_pages(spark, sf_dir):
    page = F.when(F.col("page_start") > 2, F.col("page_start")).otherwise(-1)
    return view(spark, sf_dir, "blocks").groupBy("category", "status").agg(F.coalesce(F.min(F.when(page > 0, page)), F.lit(-1)).alias("first"), F.coalesce(F.max(F.when(page > 0, page)), F.lit(-1)).alias("last"))


def agg21_cache_size(spark, sf_dir):
    return view(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))


def agg22_overload(spark, sf_dir):
    return _turns(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("offered"), F.round(F.try_divide(F.count_if(F.col("seconds") > 120), F.count("*")), 4).alias("shed"))


def agg29_issue_rollup(spark, sf_dir):
    flags = F.array(F.col("n_chars") < 400, F.contains("text", F.lit("|")), F.col("text").rlike("%%%|###"))
    d = _docs(spark, sf_dir).select("lang", flags.alias("f"))
    return d.groupBy("lang").agg(F.count_if(F.exists("f", lambda x: x)).alias("flagged_any"), F.count_if(F.element_at("f", 3)).alias("flagged_high"), F.count("*").alias("n"))


def agg30_accuracy(spark, sf_dir):
    guess = F.when(F.length("text") > 1500, 1).otherwise(0)
    d = _docs(spark, sf_dir).join(view(spark, sf_dir, "labels"), "doc_id").select("lang", (guess == F.col("quality")).alias("q"), (F.lit(0) == F.col("toxic")).alias("t"))
    return d.groupBy("lang").agg(F.round(F.avg(F.col("q").cast("double")), 6).alias("quality"), F.round(F.avg(F.col("t").cast("double")), 6).alias("toxic"), F.count("*").alias("n"))


def txt10_sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(sentences(F.col("text"))).alias("sentences"))


def txt13_keyword(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("lang").agg(F.count_if(has_keyword(F.col("text"), ["idiot", "ensch", "password"])).alias("n"))


def txt17_garble(spark, sf_dir):
    n = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    ratio = F.round(F.coalesce(F.try_divide(n(r"%%%|###|&&&|\*\*\*"), n(r"\S+")), F.lit(0.0)), 6)
    return _docs(spark, sf_dir).select("doc_id", ratio.alias("ratio"), ((ratio >= 0.06) & (n(r"\S+") >= 12)).alias("garbled"))


def txt24_in_words(spark, sf_dir):
    return view(spark, sf_dir, "part").select("p_partkey", in_words(F.col("p_partkey") * 12345).alias("words"))


def txt28_repair(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.length(F.regexp_replace("text", r" (?=[,.;])", "")).alias("n"))


def txt31_rank_filters(spark, sf_dir):
    """Constraints that a question names without doubt. A question is asked for each record; every ninth names two years."""
    said = F.concat_ws(" ", F.lit("closing rank"), F.col("year").cast("string"), F.when(F.col("record_id") % 9 == 0, (F.col("year") + 1).cast("string")), F.concat(F.lit("round "), F.col("round")), "programme", "seat_category", F.concat(F.lit("authority "), "authority"), F.when(F.col("quota") == "O", "quota O"), F.when(F.col("record_id") % 4 == 0, "for women with pwd"))
    asked = view(spark, sf_dir, "records").select("record_id", said.alias("q"))
    return asked.select("record_id", *(F.coalesce(c, F.lit("-")).alias(n) for n, c in rank_filters(F.col("q")).items()))


def txt32_term_match(spark, sf_dir):
    """The six documents that share most terms with each benchmark item."""
    q = view(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.filter(words(F.col("text"), True), lambda w: F.length(w) > 2))).alias("term"))
    # dealt by document first, so that the overlaps are counted where the terms are
    d = _docs(spark, sf_dir).select("doc_id", F.array_distinct(words(F.col("text"), True)).alias("terms")).repartition("doc_id").select("doc_id", F.explode("terms").alias("term"))
    n = d.join(q, "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("overlap"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("overlap"), "doc_id"))).where("rank <= 6")


def txt33_follow_up(spark, sf_dir):
    """The lines of an order as a dialogue: the first asks in full, later ones name a category, a round, or neither.

    Lines of one number and amount come by their category, so that the questions don't depend on the order of the rows read (the SQL leaves these ties open).
    """
    r = view(spark, sf_dir, "records")
    w = W.partitionBy("evidence_id").orderBy("record_id", "amount", "seat_category")
    full = F.concat_ws(" ", F.lit("fee for"), "seat_category", F.lit("in round"), "round")
    now = F.when(F.col("record_id") % 3 == 0, full).when(F.col("record_id") % 3 == 1, F.concat(F.lit("and "), F.col("seat_category"), F.lit("?"))).otherwise(F.concat(F.lit("round "), F.col("round")))
    asked = r.select("record_id", "amount", F.lag(full).over(w).alias("before"), now.alias("now"))
    return asked.select("record_id", "amount", follow_up(F.col("before"), F.col("now")).alias("question"))


def arr02_table_cells(spark, sf_dir):
    return cells_of(lines_of(_docs(spark, sf_dir))).groupBy("doc_id").agg(F.countDistinct("pos").alias("rows"), F.max(F.col("col") + 1).alias("columns"), F.count_if(F.col("cell") != "").alias("filled"))


def arr03_headers(spark, sf_dir):
    """Rows of cells with few numbers count as headers."""
    share = F.avg(F.when(F.col("cell").rlike("[0-9]"), 1.0).otherwise(0.0))
    rows = cells_of(lines_of(_docs(spark, sf_dir))).groupBy("doc_id", "pos").agg(share.alias("numeric"))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("numeric") <= 0.2).alias("headers"), F.count("*").alias("rows"))


def arr05_real_tables(spark, sf_dir):
    c = cells_of(lines_of(_docs(spark, sf_dir)))
    t = c.groupBy("doc_id").agg(F.avg((F.col("cell") != "").cast("double")).alias("fill"), F.countDistinct(F.when(F.col("cell") != "", F.col("col"))).alias("columns"))
    return t.select("doc_id", ((F.col("fill") >= 0.25) & (F.col("columns") >= 2)).alias("real"))


def fct01_amounts(spark, sf_dir):
    """Lines with exactly one number, as amounts of their document."""
    found = F.regexp_extract_all("line", F.lit(r"\d[\d,]*"), F.lit(0))
    lines = lines_of(_docs(spark, sf_dir)).where(F.size(found) == 1)
    return lines.select("doc_id", "pos", F.try_to_number(F.replace(found[0], F.lit(","), F.lit("")), F.lit("99999999999999999999999")).cast("decimal(38,0)").alias("amount")).where("amount is not null and amount < 1000000000").select("doc_id", "pos", F.col("amount").cast("long"))


def ret08_legacy_fusion(spark, sf_dir):
    b = view(spark, sf_dir, "blocks").select(F.col("category").alias("item_id"), F.sha1("text").alias("key"), "block_id", "n_chars")
    w = W.partitionBy("item_id")
    one = b.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n_chars"), "block_id"))).where("rank <= 40")
    two = b.withColumn("rank", F.row_number().over(w.orderBy("n_chars", "block_id"))).where("rank <= 40")
    return legacy_fuse(one.unionByName(two).select("item_id", "key", "rank"))


def ret09_priority(spark, sf_dir):
    p = F.when(F.col("text").rlike(r"(?i)\bpassword\b"), -1).when(F.contains("text", F.lit("|")), 2).when(F.col("n_chars") > 2000, 1).otherwise(0)
    return _docs(spark, sf_dir).groupBy(p.alias("priority")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def ret10_policies(spark, sf_dir):
    rules = spark.sql("select * from (values (1, 'first', 'thon', 'ing '), (2, 'second', 'ion', 'zzz'), (3, 'third', 'e', 'qqq')) as t(order, rule, pattern, exclude)")
    return bind_policy(view(spark, sf_dir, "benchmark"), rules)


def ret13_assembly(spark, sf_dir):
    b = view(spark, sf_dir, "blocks").select(F.col("source_id").alias("item_id"), F.col("block_id").alias("doc_id"), "status", "n_chars")
    w = W.partitionBy("item_id")
    facts = b.where("status = 'approved'").withColumn("rank", F.row_number().over(w.orderBy("doc_id"))).where("rank <= 2")
    ranked = b.where(F.col("status").isin(*SERVABLE)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n_chars"), "doc_id"))).where("rank <= 10")
    related = b.withColumn("rank", F.row_number().over(w.orderBy(F.desc("doc_id")))).where("rank <= 4")
    return assemble(facts, ranked, related, 6)


def evl01_case_scores(spark, sf_dir):
    """Items as cases: the expected sources are those of documents that hold the item's first words."""
    b = view(spark, sf_dir, "blocks")
    cases = b.groupBy(F.col("category").alias("case_id")).agg(F.array_sort(F.collect_set(F.when(F.col("status") == "approved", F.col("source_id")))).alias("expected"))
    hits = b.withColumn("rank", F.row_number().over(W.partitionBy("category").orderBy(F.desc("n_chars"), "block_id"))).where("rank <= 6").select(F.col("category").alias("case_id"), F.col("source_id").alias("source"), "rank")
    return score_cases(cases, hits)


def evl10_certificate(spark, sf_dir):
    """Seven gates of each session; it is certified if none fails."""
    t = _turns(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("n"), F.avg("seconds").alias("mean"), F.max("seconds").alias("most"), F.count_if(F.col("status") == "error").alias("errors"), F.countDistinct("status").alias("kinds"))
    gates = {"volume": F.col("n") >= 40, "mean": F.col("mean") <= 60, "worst": F.col("most") <= 300, "errors": F.col("errors") <= 20, "kinds": F.col("kinds") == 5, "rate": F.col("errors") <= 0.25 * F.col("n"), "present": F.col("n") > 0}
    failed = F.filter(F.array(*(F.when(~g, F.lit(k)) for k, g in gates.items())), lambda x: x.isNotNull())
    return t.select("session_id", F.array_join(failed, ",").alias("failed"), (F.size(failed) == 0).alias("certified"))


def evl16_sweep(spark, sf_dir):
    grid = F.explode(F.array(*(F.lit(x / 10) for x in range(1, 10)))).alias("tau")
    t = _turns(spark, sf_dir).select((F.col("seconds") / 200).alias("p"), (F.col("status") == "purchase").alias("end"), grid)
    return t.groupBy("tau").agg(F.round(F.avg(F.when(~F.col("end"), (F.col("p") >= F.col("tau")).cast("double"))), 6).alias("false_cut"), F.round(F.avg(F.when(F.col("end"), (F.col("p") < F.col("tau")).cast("double"))), 6).alias("missed"))


def evl17_cer(spark, sf_dir):
    p = view(spark, sf_dir, "part").select("p_type", "p_name", F.concat_ws(" ", F.substring("p_name", 1, 4), "p_type").alias("heard"))
    return p.groupBy("p_type").agg(F.round(F.avg(F.levenshtein("p_name", "heard") / F.length("p_name")), 6).alias("cer"))


def evl23_risk_coverage(spark, sf_dir):
    t = _turns(spark, sf_dir).select(F.explode(F.filter(F.array(*(F.lit(float(x)) for x in range(0, 200, 20))), lambda g: g <= F.col("seconds"))).alias("threshold"), (F.col("status") == "error").cast("int").alias("wrong"))
    return t.groupBy("threshold").agg(F.count("*").alias("covered"), F.round(F.avg("wrong"), 6).alias("risk"))


def evl25_correction(spark, sf_dir):
    """Of each turn after the first, the share of the words of the turn before that it doesn't begin with."""
    w = W.partitionBy("conv_id").orderBy("turn")
    m = view(spark, sf_dir, "messages").withColumns({"b": F.split("text", r"\s+"), "a": F.lag(F.split("text", r"\s+")).over(w)}).where("a is not null")
    same = F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y))
    prefix = F.when(F.array_contains(same, False), F.array_position(same, False) - 1).otherwise(F.size("a"))
    return m.select("conv_id", "turn", F.round((F.size("a") - F.least(prefix, F.size("a"))) / F.size("a"), 6).alias("rate"))


def evl28_energy_cost(spark, sf_dir):
    return _turns(spark, sf_dir).groupBy("status").agg(F.round(F.try_divide(F.sum(F.col("seconds") * F.col("model_calls")), F.count_if(F.col("seconds") < 100)), 6).alias("energy"), F.round(F.avg(F.col("seconds") * 0.002), 8).alias("cost"))


def evl30_tool_choice(spark, sf_dir):
    tools = F.when(F.col("status") == "purchase", F.array(F.lit("cart"), F.lit("pay"))).when(F.col("status") == "view", F.array(F.lit("search"))).otherwise(F.array(F.lit("search"), F.lit("help"), F.lit("cart")))
    t = _turns(spark, sf_dir).select("model_calls", tools.alias("tools"))
    return t.groupBy("model_calls").agg(F.round(F.avg(F.array_contains("tools", "cart").cast("double")), 6).alias("hit"), F.round(F.avg(F.size("tools") / 4), 6).alias("shown"))


def evl32_agreement(spark, sf_dir):
    b = view(spark, sf_dir, "labels").join(_docs(spark, sf_dir), "doc_id").select("lang", F.explode(F.array(F.struct(F.lit("quality").alias("field"), (F.col("quality") == 1).alias("same")), F.struct(F.lit("toxic").alias("field"), (F.col("toxic") == 0).alias("same")))).alias("x"))
    return b.groupBy("lang", "x.field").agg(F.round(F.avg(F.col("x.same").cast("double")), 6).alias("agreement"))


def dst05_summary(spark, sf_dir):
    split = F.when(F.substring(F.md5(F.col("evidence_id").cast("string")), 1, 1) < "b", "train").otherwise("test")
    return view(spark, sf_dir, "records").withColumn("split", split).groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("evidence_id").alias("families"), F.countDistinct("kind").alias("kinds"))


def dst06_holdout(spark, sf_dir):
    """Cutoffs of one year that the years before never had."""
    keys = ["programme", "seat_category", "opening_rank", "closing_rank"]
    r = view(spark, sf_dir, "records").where("kind = 'cutoff' and closing_rank <> ''")
    new = r.where("year = 1997").select(*keys).distinct()
    return new.join(r.where("year < 1997").select(*keys).distinct(), keys, "left_anti").groupBy("seat_category").agg(F.count("*").alias("fresh"))


def dst07_exposure(spark, sf_dir):
    """Messages that an earlier conversation already had."""
    m = view(spark, sf_dir, "messages").select("conv_id", F.sha1("text").alias("h"))
    first = m.groupBy("h").agg(F.min("conv_id").alias("first"))
    return m.join(first, "h").groupBy("conv_id").agg((F.count_if(F.col("first") < F.col("conv_id")) == 0).alias("fresh"))


def dst10_negatives(spark, sf_dir):
    """A negative for each record: the first swap that applies."""
    r = view(spark, sf_dir, "records")
    bad = F.when(F.col("kind") == "cutoff", F.concat("kind", F.lit(" of another round"))).when(F.col("amount") > 50000, F.lit("amount halved")).otherwise(F.lit("text appended"))
    return r.groupBy("kind", bad.alias("negative")).agg(F.count("*").alias("n"))


def dst12_output_checks(spark, sf_dir):
    """Scores that aren't numbers, or whose sum strays from one."""
    p = F.array(F.col("seconds") / 500, F.coalesce("model_seconds", F.lit(float("nan"))) / 500, 1 - F.col("seconds") / 375)
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    t = _turns(spark, sf_dir).select("status", p.alias("p"))
    return t.groupBy("status", F.when(F.exists("p", F.isnan), "not finite").when(F.abs(total - 1) > 1e-1, "bad sum").otherwise("ok").alias("outcome")).agg(F.count("*").alias("n"))


def ops02_work_lists(spark, sf_dir):
    o = view(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("pending"), F.min("o_orderkey").alias("next"))


def ops04_inventory(spark, sf_dir):
    w = W.partitionBy("p_type").orderBy("p_partkey")
    return view(spark, sf_dir, "part").select("p_partkey", F.concat_ws("-", "p_type", F.format_string("Q%05d", F.row_number().over(w))).alias("number"))


def rsp01_responses(spark, sf_dir):
    t = F.create_map(F.lit("en"), F.lit("%s: %d documents"), F.lit("de"), F.lit("%s: %d Dokumente"))
    d = _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"))
    return d.select("lang", F.replace(F.replace(F.coalesce(t[F.col("lang")], F.lit("%s: %d")), F.lit("%s"), F.col("lang")), F.lit("%d"), F.col("n").cast("string")).alias("message"))


def mth02_rates(spark, sf_dir):
    ns = F.col("seconds") * 1e9
    return _turns(spark, sf_dir).select("turn_id", F.round(F.try_divide(F.lit(100.0), F.when(ns > 0, ns / 1e9)), 3).alias("rate"))


def mth03_confidence(spark, sf_dir):
    return _turns(spark, sf_dir).select("turn_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(-F.col("seconds") / 50))), 8).alias("confidence"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("jn", "agg", "txt", "arr", "fct", "ret", "evl", "dst", "ops", "rsp", "mth")) and "_" in n and n.split("_")[0][-2:].isdigit()}

_L = "(select doc_id, unnest(range(len(p))) as pos, unnest(p) as line from (select doc_id, string_split(text, chr(10)) as p from documents))"
_C = f"(select doc_id, pos, unnest(range(len(c))) as col, trim(unnest(c), ' ') as cell from (select doc_id, pos, string_split(line, '|') as c from {_L} where contains(line, '|')))"
_CW = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9À-ɏ]+|[ऀ-ॿ]+'), lambda w: length(w) > 1 and w not in ('the','a','an','of','and','to','in','is','for','on','with','by'))"
_T = lambda body: oracle(body, "turns")
_B = lambda body: oracle(body, "blocks")
_R = lambda body: oracle(body, "records")

SQL = {
    "dst05_summary": _R("select case when substr(md5(cast(evidence_id as varchar)), 1, 1) < 'b' then 'train' else 'test' end as split, count(*) as rows, count(distinct evidence_id) as families, count(distinct kind) as kinds from records group by all"),
    "txt24_in_words": "select p_partkey, case when n = 0 then 'zero' else trim(case when n >= 10000000 then w[n // 10000000 + 1] || ' crore' else '' end || case when n // 100000 % 100 > 0 then ' ' || w[n // 100000 % 100 + 1] || ' lakh' else '' end || case when n // 1000 % 100 > 0 then ' ' || w[n // 1000 % 100 + 1] || ' thousand' else '' end || case when n // 100 % 10 > 0 then ' ' || w[n // 100 % 10 + 1] || ' hundred' else '' end || case when n % 100 > 0 then ' ' || w[n % 100 + 1] else '' end) end as words from (select p_partkey, p_partkey * 12345 as n, ['" + "','".join(_BELOW_100) + "'] as w from part)",
    "jn03_overlay": _B("select source_id, count(extra) as overlaid, count(*) as n from blocks left join (select source_id, page_start, max(n_chars) as extra from blocks where status = 'approved' group by all) using (source_id, page_start) group by all"),
    "jn09_page_range": _B("select prefix, page, count(*) as blocks, min(block_id) as first from blocks join (select distinct substr(source_id, 1, 4) as prefix, page_start as page from blocks where status = 'approved') t on starts_with(source_id, prefix) and page between page_start and page_end group by all"),
    "jn11_unit_parents": _B("select p.status, count(*) as units, count(distinct u.parent) as parents from (select distinct block_id, unnest([block_id - block_id % 3, block_id]) as parent from blocks) u join blocks p on p.block_id = u.parent group by all"),
    "jn14_family_overlap": _T("select session_id, count(distinct turn_id < 500) as splits from turns group by all having count(distinct turn_id < 500) > 1"),
    "jn16_owned_keys": _T("select status || '|' || model_calls as key, count(distinct session_id) as owners from turns where (status, model_calls) in (select (status, model_calls) from turns where session_id < 3) group by all"),
    "agg07_recall": _T("select model_calls, round(count(*) filter (where status <> 'error' and seconds < 90) / greatest(1, count(*) filter (where status <> 'error')), 4) as recall from turns group by all"),
    "agg08_pages": _B("select category, status, coalesce(min(case when page_start > 2 then page_start end), -1) as first, coalesce(max(case when page_start > 2 then page_start end), -1) as last from blocks group by all"),
    "agg21_cache_size": "select role, count(*) as n, cast(coalesce(sum(strlen(text)), 0) as bigint) as bytes from conversations group by all",
    "agg22_overload": _T("select session_id, count(*) as offered, round(count(*) filter (where seconds > 120) / count(*), 4) as shed from turns group by all"),
    "agg29_issue_rollup": "select lang, count(*) filter (where n_chars < 400 or contains(text, '|') or regexp_matches(text, '%%%|###')) as flagged_any, count(*) filter (where regexp_matches(text, '%%%|###')) as flagged_high, count(*) as n from documents group by all",
    "agg30_accuracy": "select lang, round(avg(case when (length(text) > 1500) = (quality = 1) then 1.0 else 0.0 end), 6) as quality, round(avg(case when toxic = 0 then 1.0 else 0.0 end), 6) as toxic, count(*) as n from documents join labels using (doc_id) group by all",
    "txt10_sentences": "select doc_id, len(list_filter(string_split_regex(regexp_replace(text, '([.!?।॥])\\s+([A-ZÀ-Þऀ-ॿ])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x, ' ') <> '')) as sentences from documents",
    "txt13_keyword": "select lang, count(*) filter (where regexp_matches(lower(text), '(^|[^\\pL\\pN_])(idiot|ensch|password)($|[^\\pL\\pN_])')) as n from documents group by all",
    "txt17_garble": "select doc_id, r as ratio, r >= 0.06 and n >= 12 as garbled from (select doc_id, n, round(coalesce(g / nullif(n, 0), 0), 6) as r from (select doc_id, len(regexp_extract_all(text, '%%%|###|&&&|\\*\\*\\*')) as g, len(regexp_extract_all(text, '\\S+')) as n from documents))",
    "txt28_repair": "select doc_id, length(regexp_replace(text, ' ([,.;])', '\\1', 'g')) as n from documents",
    "txt31_rank_filters": _R("select record_id, case when record_id % 9 = 0 then '-' else cast(year as varchar) end as year, round, programme, seat_category, authority, case when quota = 'O' then 'o' else '-' end as quota, case when record_id % 4 = 0 then 'women' else '-' end as gender, case when record_id % 4 = 0 then 'pwd' else '-' end as pwd, 'closing' as basis from records"),
    "txt32_term_match": f"select item_id, doc_id, overlap, rank from (select *, row_number() over (partition by item_id order by overlap desc, doc_id) as rank from (select item_id, doc_id, count(*) as overlap from (select item_id, unnest(list_distinct(list_filter({_CW.format('text')}, lambda x: length(x) > 2))) as term from benchmark) join (select doc_id, unnest(list_distinct({_CW.format('text')})) as term from documents) using (term) group by all)) where rank <= 6",
    "txt33_follow_up": _R("select record_id, amount, case when k = 0 or p is null then case k when 0 then 'fee for ' || seat_category || ' in round ' || round when 1 then 'and ' || seat_category || '?' else 'round ' || round end when k = 1 then 'fee for ' || seat_category || ' in round ' || pr else 'fee for ' || p || ' in round ' || round end as question from (select *, record_id % 3 as k, lag(seat_category) over w as p, lag(round) over w as pr from records window w as (partition by evidence_id order by record_id, amount))"),
    "arr02_table_cells": f"select doc_id, count(distinct pos) as rows, max(col) + 1 as columns, count(*) filter (where cell <> '') as filled from {_C} group by all",
    "arr03_headers": f"select doc_id, count(*) filter (where s <= 0.2) as headers, count(*) as rows from (select doc_id, pos, avg(case when regexp_matches(cell, '[0-9]') then 1.0 else 0.0 end) as s from {_C} group by all) group by all",
    "arr05_real_tables": f"select doc_id, avg(case when cell <> '' then 1.0 else 0.0 end) >= 0.25 and count(distinct case when cell <> '' then col end) >= 2 as real from {_C} group by all",
    "fct01_amounts": f"select doc_id, pos, a as amount from (select doc_id, pos, try_cast(replace(regexp_extract_all(line, '\\d[\\d,]*')[1], ',', '') as bigint) as a from {_L} where len(regexp_extract_all(line, '\\d[\\d,]*')) = 1) where a < 1000000000",
    "ret08_legacy_fusion": _B("select category as item_id, sha1(text) as key, round(sum(1 / (60 + rank)), 8) as score from (select category, text, row_number() over (partition by category order by n_chars desc, block_id) as rank from blocks union all select category, text, row_number() over (partition by category order by n_chars, block_id) from blocks) where rank <= 40 group by all"),
    "ret09_priority": "select case when regexp_matches(text, '(?i)\\bpassword\\b') then -1 when contains(text, '|') then 2 when n_chars > 2000 then 1 else 0 end as priority, count(*) as n, min(doc_id) as first from documents group by all",
    "ret10_policies": "select item_id, arg_min(rule, o) as rule from benchmark join (values (1, 'first', 'thon', 'ing '), (2, 'second', 'ion', 'zzz'), (3, 'third', 'e', 'qqq')) as t(o, rule, p, e) on contains(lower(text), p) and not contains(lower(text), e) group by all",
    "ret13_assembly": _B("select item_id, doc_id, section, position from (select *, row_number() over (partition by item_id order by section, rank, doc_id) as position from (select source_id as item_id, block_id as doc_id, section, rank from (select *, 0 as section, row_number() over (partition by source_id order by block_id) as rank, 2 as m from blocks where status = 'approved' union all select *, 1, row_number() over (partition by source_id order by n_chars desc, block_id), 10 from blocks where status in ('approved','extracted','machine_verified') union all select *, 2, row_number() over (partition by source_id order by block_id desc), 4 from blocks) where rank <= m qualify row_number() over (partition by source_id, block_id order by section, rank) = 1)) where position <= 6 or section = 2 and position <= 8"),
    "evl01_case_scores": _B("select case_id, round(coalesce(1 / f, 0), 6) as rr, coalesce(f = 1, false) as pass1, coalesce(f <= 3, false) as pass3, f is not null as found from (select distinct category as case_id from blocks) left join (select category as case_id, min(rank) as f from (select *, row_number() over (partition by category order by n_chars desc, block_id) as rank from blocks) h where rank <= 6 and (category, source_id) in (select (category, source_id) from blocks where status = 'approved') group by all) using (case_id)"),
    "evl10_certificate": _T("select session_id, array_to_string(f, ',') as failed, len(f) = 0 as certified from (select session_id, list_filter([case when not n >= 40 then 'volume' end, case when not mean <= 60 then 'mean' end, case when not most <= 300 then 'worst' end, case when not errors <= 20 then 'errors' end, case when kinds <> 5 then 'kinds' end, case when not errors <= 0.25 * n then 'rate' end], lambda x: x is not null) as f from (select session_id, count(*) as n, avg(seconds) as mean, max(seconds) as most, count(*) filter (where status = 'error') as errors, count(distinct status) as kinds from turns group by all))"),
    "evl16_sweep": _T("select t / 10 as tau, round(avg(case when status <> 'purchase' then case when seconds / 200 >= t / 10 then 1.0 else 0.0 end end), 6) as false_cut, round(avg(case when status = 'purchase' then case when seconds / 200 < t / 10 then 1.0 else 0.0 end end), 6) as missed from turns, range(1, 10) as g(t) group by all"),
    "evl17_cer": "select p_type, round(avg(levenshtein(p_name, substr(p_name, 1, 4) || ' ' || p_type) / length(p_name)), 6) as cer from part group by all",
    "evl23_risk_coverage": _T("select cast(g as double) as threshold, count(*) as covered, round(avg(case when status = 'error' then 1.0 else 0.0 end), 6) as risk from turns, range(0, 200, 20) as r(g) where g <= seconds group by all"),
    "evl25_correction": "select conv_id, turn, round((len(a) - least(coalesce(list_position(list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] is not distinct from b[i]), false) - 1, len(a)), len(a))) / len(a), 6) as rate from (select conv_id, turn, string_split_regex(text, '\\s+') as b, lag(string_split_regex(text, '\\s+')) over (partition by conv_id order by turn) as a from conversations) where a is not null",
    "evl28_energy_cost": _T("select status, round(sum(seconds * model_calls) / nullif(count(*) filter (where seconds < 100), 0), 6) as energy, round(avg(seconds * 0.002), 8) as cost from turns group by all"),
    "evl30_tool_choice": _T("select model_calls, round(avg(case when status = 'view' then 0.0 else 1.0 end), 6) as hit, round(avg(case status when 'purchase' then 0.5 when 'view' then 0.25 else 0.75 end), 6) as shown from turns group by all"),
    "evl32_agreement": "select lang, field, round(avg(case when s then 1.0 else 0.0 end), 6) as agreement from (select lang, 'quality' as field, quality = 1 as s from labels join documents using (doc_id) union all select lang, 'toxic', toxic = 0 from labels join documents using (doc_id)) group by all",
    "dst06_holdout": _R("select seat_category, count(*) as fresh from (select programme, seat_category, opening_rank, closing_rank from records where kind = 'cutoff' and closing_rank <> '' and year = 1997 except select programme, seat_category, opening_rank, closing_rank from records where kind = 'cutoff' and closing_rank <> '' and year < 1997) group by all"),
    "dst07_exposure": "select conv_id, count(*) filter (where f < conv_id) = 0 as fresh from (select conv_id, min(conv_id) over (partition by text) as f from conversations) group by all",
    "dst10_negatives": _R("select kind, case when kind = 'cutoff' then 'cutoff of another round' when amount > 50000 then 'amount halved' else 'text appended' end as negative, count(*) as n from records group by all"),
    "dst12_output_checks": _T("select status, case when model_seconds is null then 'not finite' when abs(seconds / 500 + model_seconds / 500 + 1 - seconds / 375 - 1) > 0.1 then 'bad sum' else 'ok' end as outcome, count(*) as n from turns group by all"),
    "ops02_work_lists": "select o_orderpriority, count(*) as pending, min(o_orderkey) as next from orders where o_orderstatus = 'O' group by all",
    "ops04_inventory": "select p_partkey, p_type || '-Q' || lpad(cast(row_number() over (partition by p_type order by p_partkey) as varchar), 5, '0') as number from part",
    "rsp01_responses": "select lang, lang || ': ' || n || case lang when 'en' then ' documents' when 'de' then ' Dokumente' else '' end as message from (select lang, count(*) as n from documents group by all)",
    "mth02_rates": _T("select turn_id, round(100 / nullif(seconds, 0), 3) as rate from turns"),
    "mth03_confidence": _T("select turn_id, round(least(1, greatest(0, exp(-seconds / 50))), 8) as confidence from turns"),
}
