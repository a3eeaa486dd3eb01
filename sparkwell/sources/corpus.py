"""Sources and sinks: registering files, snapshots, readers for lines, JSON and HTML, chrome detection, renderers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwell.functions.text import slug
from sparkwell.plans.views import view


def sniff(head: Column) -> Column:
    """Format of a file by its first bytes (as text); null if unsupported."""
    lower = F.lower(F.substring(head, 1, 512))
    return (
        F.when(head.startswith("%PDF"), "pdf").when(head.startswith("PK\x03\x04"), "zip").when(lower.rlike(r"^\s*(<!doctype html|<html)"), "html")
        .when(lower.rlike(r"^(from|to|subject|received): "), "email").when(lower.rlike(r"^\s*[\[{]"), "json").when(F.length(head) > 0, "text")
    )


def scan(spark, path: str, ignore: str = r"(^|/)\.") -> DataFrame:
    """Files below a folder, in any depth, with size, digest and format; names that match ignore are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    head = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    return files.where(~F.col("path").rlike(ignore)).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), sniff(head).alias("format"))


def skip_reason(name: Column, size: Column, least: int, most: int) -> Column:
    return F.when(name.rlike(r"^src1[0-9]$"), "ignored name").when(size > most, "too large").when(size < least, "too small")


def exact_duplicates(files: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """files with duplicate_of: for all but the first of equal digests, the first one's path."""
    first = files.groupBy(digest).agg(F.min_by("path", F.struct(*order)).alias("_first"))  # combined where the rows are: a digest may be that of many
    found = files.join(first, digest, "left").withColumn("duplicate_of", F.when(F.col("path") != F.col("_first"), F.col("_first")))
    return found.select(*files.columns, "duplicate_of")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key and change (new, removed)."""
    a, b = before.select(key).distinct(), after.select(key).distinct()
    new = b.join(a, key, "left_anti").withColumn("change", F.lit("new"))
    return new.unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def line_kind(line: Column) -> Column:
    """Element type of a line of plain or marked text."""
    return (
        F.when(F.trim(line) == "", "blank").when(line.rlike(r"^#{1,6} "), "heading").when(line.rlike(r"^\s*([-*]|\d+\.) "), "list_item")
        .when(F.contains(line, F.lit("|")), "table_row").when(line.startswith("```"), "fence").when((F.length(line) < 60) & ~line.rlike(r"[.,;:!?]\s*$"), "heading_like").otherwise("paragraph")
    )


def page_route(chars: Column, digits: Column, markers: Column, lines: Column) -> Column:
    """How a page should be read, from its features."""
    return (
        F.when(chars == 0, "blank").when(markers > 5, "broken_text").when(digits * 5 > chars, "table_heavy").when(chars < 200, "scanned").when(lines > 100, "long_form").otherwise("native")
    )


def html_elements(pages: DataFrame) -> DataFrame:
    """page_id, pos, kind, text of the headings, paragraphs and items of a page's main part, in order; repeated texts once.

    The main part is the article if it has more than 40 characters of text, else the body without
    navigation, header, footer and scripts.
    """
    bare = F.regexp_replace("html", r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    article = F.regexp_extract(bare, r"(?s)<article\b[^>]*>(.*?)</article>", 1)
    body = F.regexp_replace(F.regexp_extract(bare, r"(?s)<body\b[^>]*>(.*)", 1), r"(?s)<(nav|footer|header)\b.*?</\1>", "")
    main = F.when(F.length(_strip_tags(article)) > 40, article).otherwise(body)
    parts = pages.select("page_id", F.posexplode(F.split(main, r"<(?=(?:h[1-6]|p|li|blockquote|div)\b)")).alias("pos", "part"))
    kind = F.regexp_extract("part", r"^(h[1-6]|p|li|blockquote|div)\b", 1)
    text = _strip_tags(F.regexp_replace("part", r"^(?:h[1-6]|p|li|blockquote|div)\b[^>]*>", ""))
    rows = parts.select("page_id", "pos", kind.alias("kind"), text.alias("text")).where("text <> ''")
    first = W.partitionBy("page_id", "text").orderBy("pos")
    return rows.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def _strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"\s+", " "))


def site_chrome(lines: DataFrame, site: str, page: str, line: str, share: float = 0.35, least_pages: int = 4) -> DataFrame:
    """Lines on a share of a site's pages or more, on sites of enough pages."""
    pages = lines.groupBy(site).agg(F.countDistinct(page).alias("pages")).where(F.col("pages") >= least_pages)
    on = lines.select(site, page, line).distinct().groupBy(site, line).agg(F.count("*").alias("on"))
    return on.join(pages, site).where(F.col("on") >= share * F.col("pages"))


def _docs(spark, sf_dir):
    return view(spark, sf_dir, "documents")


def src02_sniff(spark, sf_dir):
    d, p = _docs(spark, sf_dir).select(F.col("text").alias("head")), view(spark, sf_dir, "pages").select(F.col("html").alias("head"))
    return d.unionByName(p).unionByName(view(spark, sf_dir, "events").select(F.col("props").alias("head"))).groupBy(F.coalesce(sniff(F.col("head")), F.lit("none")).alias("format")).agg(F.count("*").alias("n"))


def src03_skip_rules(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(F.coalesce(skip_reason(F.col("source"), F.col("n_chars"), 300, 12000), F.lit("read")).alias("reason")).agg(F.count("*").alias("n"))


def src04_fingerprint(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha256"))


def src05_exact_duplicates(spark, sf_dir):
    files = _docs(spark, sf_dir).select("doc_id", F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), F.sha2("text", 256).alias("sha"))
    return exact_duplicates(files, "sha", ["path"]).where("duplicate_of is not null").select("path", "duplicate_of")


def src06_snapshot_diff(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    return snapshot_diff(d.where("source <> 'src1'"), d.where("source <> 'src2'"), "sha")


def src07_metadata_overlay(spark, sf_dir):
    side = view(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    defaults = _docs(spark, sf_dir).groupBy("source").agg(F.min("lang").alias("default_lang"))
    return _docs(spark, sf_dir).join(side, "doc_id", "left").join(defaults, "source").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce(F.nullif("lang", F.lit("en")), "default_lang").alias("lang"))


def src09_doc_id(spark, sf_dir):
    key = F.concat_ws("-", slug(F.col("lang"), 20), slug(F.regexp_replace(F.substring("text", 1, 60), "[^A-Za-z0-9 ]", " "), 40), F.substring(F.sha2("text", 256), 1, 8))
    return _docs(spark, sf_dir).select("doc_id", key.alias("key"))


def src10_row_chunks(spark, sf_dir):
    """Rows of each file in tables of 200."""
    w = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    rows = view(spark, sf_dir, "lineitem").withColumn("chunk", F.floor((F.row_number().over(w) - 1) / 200))
    return rows.groupBy("l_suppkey", "chunk").agg(F.count("*").alias("rows"), F.min("l_orderkey").alias("first"))


def src11_json_rows(spark, sf_dir):
    props = F.from_json("props", "map<string,string>")
    return view(spark, sf_dir, "events").select("event_type", F.explode(props).alias("key", "value")).groupBy("event_type", "key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_values"))


def src13_line_elements(spark, sf_dir):
    """Kinds of lines, and paragraphs as runs of paragraph lines."""
    w = W.partitionBy("doc_id").orderBy("pos")
    rows = lines_of(_docs(spark, sf_dir)).withColumn("kind", line_kind(F.col("line")))
    rows = rows.withColumn("para", F.sum(F.when((F.col("kind") == "paragraph") & (F.coalesce(F.lag("kind").over(w), F.lit("")) == "paragraph"), 0).otherwise(1)).over(w))
    return rows.groupBy("doc_id", "kind").agg(F.count("*").alias("lines"), F.countDistinct("para").alias("elements"))


def src14_anchors(spark, sf_dir):
    """Each turn under the last user turn before it, as pages under their anchors."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    anchor = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w)
    return view(spark, sf_dir, "messages").select("conv_id", "turn", F.coalesce(anchor, F.lit(-1)).alias("anchor"))


def src15_html_elements(spark, sf_dir):
    return html_elements(view(spark, sf_dir, "pages")).select("page_id", "kind", F.length("text").alias("n")).groupBy("page_id", "kind").agg(F.count("*").alias("elements"), F.sum("n").alias("chars"))


def src16_navigation_lists(spark, sf_dir):
    """Lists of three items or more whose items are nearly all link text."""
    lists = view(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<ul>(.*?)</ul>"), F.lit(1))).alias("ul"))
    items = F.size(F.regexp_extract_all("ul", F.lit("<li"), F.lit(0)))
    linked = F.aggregate(F.regexp_extract_all("ul", F.lit(r"<a [^>]*>([^<]*)</a>"), F.lit(1)), F.lit(0), lambda s, x: s + F.length(x))
    total = F.length(F.regexp_replace("ul", "<[^>]*>", ""))
    return lists.select("page_id", items.alias("items"), ((items >= 3) & (linked >= 0.9 * total)).alias("navigation"))


def src17_site_chrome(spark, sf_dir):
    p = view(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"\.(\w+)/", 1).alias("site"), F.explode(F.regexp_extract_all("html", F.lit(r"<li><a [^>]*>([^<]*)</a></li>"), F.lit(1))).alias("line"))
    return site_chrome(p, "site", "page_id", "line", share=0.05)


def src19_page_route(spark, sf_dir):
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    r = page_route(F.length("text"), count("[0-9]"), count("%%%|###|&&&"), count("\n"))
    return _docs(spark, sf_dir).select("doc_id", r.alias("route"))


def src20_route_histogram(spark, sf_dir):
    return src19_page_route(spark, sf_dir).groupBy("route").agg(F.count("*").alias("n"))


def src21_word_rows(spark, sf_dir):
    """Marks in order of time form a row until the gap exceeds a share of the usual gap."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    t = view(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 1e6
    rows = t.withColumn("row", F.sum(F.when(gap > 3600 * 6, 1).otherwise(0)).over(w))
    return rows.groupBy("user_id", "row").agg(F.count("*").alias("marks"), F.min("event_id").alias("first"))


def src25_upsert(spark, sf_dir):
    old = view(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("old"))
    new = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("new"))
    return old.join(new, "id", "full").select("id", F.coalesce("new", "old").alias("name"), F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "kept").otherwise("replaced").alias("change"))


def src28_render(spark, sf_dir):
    """Typed lines back to marked text."""
    rows = lines_of(_docs(spark, sf_dir)).withColumn("kind", line_kind(F.col("line"))).where("kind <> 'blank'")
    text = F.when(F.col("kind") == "heading_like", F.concat(F.lit("## "), "line")).when(F.col("kind") == "table_row", F.concat(F.lit("| "), "line")).otherwise(F.col("line"))
    doc = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))).alias("parts"))
    return doc.select("doc_id", F.sha2(F.array_join(F.transform("parts", lambda x: x["t"]), "\n\n"), 256).alias("sha"), F.size("parts").alias("n"))


def src29_review_sheet(spark, sf_dir):
    r = view(spark, sf_dir, "records").where("kind = 'fee' and programme = 'programme-3'")
    e = view(spark, sf_dir, "evidence").select("evidence_id", "title")
    return r.join(e, "evidence_id", "left").select("record_id", "amount", F.coalesce(F.nullif("closing_rank", F.lit("")), F.col("amount").cast("string")).alias("value"), F.coalesce("title", F.lit("?")).alias("title"))


def src32_answers(spark, sf_dir):
    """Assistant answers with the user message before them."""
    w = W.partitionBy("conv_id").orderBy("turn")
    asked = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    return view(spark, sf_dir, "messages").withColumn("q", asked).where("role = 'assistant' and q is not null").select("conv_id", "turn", F.sha1("q").alias("question"), F.length("text").alias("n"))


def src35_token_stream(spark, sf_dir):
    """Tokens of each answer in order, with the length of the text so far."""
    t = view(spark, sf_dir, "messages").where("role = 'system'").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+|\s+"), F.lit(0))).alias("pos", "token"))
    return t.select("conv_id", "turn", "pos", F.sum(F.length("token")).over(W.partitionBy("conv_id", "turn").orderBy("pos")).alias("so_far"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("src") and callable(f)}

_KIND = """case when trim(line, ' ') = '' then 'blank' when regexp_matches(line, '^#{1,6} ') then 'heading' when regexp_matches(line, '^\\s*([-*]|\\d+\\.) ') then 'list_item' when contains(line, '|') then 'table_row'
    when starts_with(line, '```') then 'fence' when length(line) < 60 and not regexp_matches(line, '[.,;:!?]\\s*$') then 'heading_like' else 'paragraph' end"""
_LINES = "select doc_id, unnest(range(len(p))) as pos, unnest(p) as line from (select doc_id, string_split(text, chr(10)) as p from documents)"
_ROUTE = "case when length(text) = 0 then 'blank' when len(regexp_extract_all(text, '%%%|###|&&&')) > 5 then 'broken_text' when len(regexp_extract_all(text, '[0-9]')) * 5 > length(text) then 'table_heavy' when length(text) < 200 then 'scanned' when len(string_split(text, chr(10))) - 1 > 100 then 'long_form' else 'native' end"
_SNIFF = "case when starts_with(head, '%PDF') then 'pdf' when regexp_matches(lower(substr(head, 1, 512)), '^\\s*(<!doctype html|<html)') then 'html' when regexp_matches(lower(substr(head, 1, 512)), '^(from|to|subject|received): ') then 'email' when regexp_matches(head, '^\\s*[\\[{]') then 'json' when length(head) > 0 then 'text' else 'none' end"
_SLUG = "regexp_replace(substr(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, {1}), '-+$', '')"
_STRIP = "trim(regexp_replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


def _o(body: str, *names: str) -> str:
    from sparkwell.plans.views import oracle

    return oracle(body, *names)


SQL = {
    "src02_sniff": f"select {_SNIFF} as format, count(*) as n from (select text as head from documents union all select html from pages union all select props from events) group by all",
    "src03_skip_rules": "select case when regexp_matches(source, '^src1[0-9]$') then 'ignored name' when n_chars > 12000 then 'too large' when n_chars < 300 then 'too small' else 'read' end as reason, count(*) as n from documents group by all",
    "src04_fingerprint": "select doc_id, sha256(text) as sha256 from documents",
    "src05_exact_duplicates": "select path, first as duplicate_of from (select path, first_value(path) over w as first, row_number() over w as r from (select source || '/' || lpad(cast(doc_id as varchar), 12, '0') as path, text from documents) window w as (partition by text order by path)) where r > 1",
    "src06_snapshot_diff": "with a as (select distinct sha256(text) as sha from documents where source <> 'src1'), b as (select distinct sha256(text) as sha from documents where source <> 'src2') select sha, 'new' as change from b where sha not in (select sha from a) union all select sha, 'removed' from a where sha not in (select sha from b)",
    "src07_metadata_overlay": "select d.doc_id, coalesce(l.q, -1) as quality, coalesce(nullif(d.lang, 'en'), f.m) as lang from documents d left join (select doc_id, max(quality) as q from labels group by all) l using (doc_id) join (select source, min(lang) as m from documents group by all) f on f.source = d.source",
    "src09_doc_id": f"select doc_id, concat_ws('-', {_SLUG.format('lang', 20)}, {_SLUG.format(chr(114) + 'egexp_replace(substr(text, 1, 60), ' + chr(39) + '[^A-Za-z0-9 ]' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')', 40)}, substr(sha256(text), 1, 8)) as key from documents",
    "src10_row_chunks": "select l_suppkey, chunk, count(*) as rows, min(l_orderkey) as first from (select *, (row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) - 1) // 200 as chunk from lineitem) group by all",
    "src11_json_rows": "select event_type, key, count(*) as n, count(distinct v) as distinct_values from (select event_type, unnest(json_keys(props)) as key, json_extract_string(props, '$.k') as v from events) group by all",
    "src13_line_elements": f"select doc_id, kind, count(*) as lines, count(distinct para) as elements from (select *, sum(case when kind = 'paragraph' and coalesce(before, '') = 'paragraph' then 0 else 1 end) over (partition by doc_id order by pos) as para from (select *, lag(kind) over (partition by doc_id order by pos) as before from (select *, {_KIND} as kind from ({_LINES})))) group by all",
    "src14_anchors": "select conv_id, turn, coalesce(last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding), -1) as anchor from conversations",
    "src15_html_elements": f"""with m as (select page_id, regexp_extract(b, '<article\\b[^>]*>(.*?)</article>', 1, 's') as article, regexp_replace(regexp_extract(b, '<body\\b[^>]*>(.*)', 1, 's'), '<nav\\b.*?</nav>|<footer\\b.*?</footer>|<header\\b.*?</header>', '', 'gs') as body from (select page_id, regexp_replace(html, '<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', '', 'gs') as b from pages)),
        x as (select page_id, regexp_replace(case when length({_STRIP.format('article')}) > 40 then article else body end, '<(h[1-6]|p|li|blockquote|div)\\b', chr(1) || '\\1', 'g') as main from m),
        p as (select page_id, unnest(range(len(s))) as pos, unnest(s) as part from (select page_id, string_split(main, chr(1)) as s from x)),
        r as (select page_id, pos, regexp_extract(part, '^(h[1-6]|p|li|blockquote|div)\\b', 1) as kind, {_STRIP.format("regexp_replace(part, '^(?:h[1-6]|p|li|blockquote|div)" + chr(92) + "b[^>]*>', '')")} as text from p)
        select page_id, kind, count(*) as elements, cast(sum(length(text)) as bigint) as chars from (select * from r where text <> '' qualify row_number() over (partition by page_id, text order by pos) = 1) group by all""",
    "src16_navigation_lists": "select page_id, i as items, i >= 3 and a >= 0.9 * t as navigation from (select page_id, len(regexp_extract_all(ul, '<li')) as i, coalesce(list_sum(list_transform(regexp_extract_all(ul, '<a [^>]*>([^<]*)</a>', 1), lambda x: length(x))), 0) as a, length(regexp_replace(ul, '<[^>]*>', '', 'g')) as t from (select page_id, unnest(regexp_extract_all(html, '<ul>(.*?)</ul>', 1, 's')) as ul from pages))",
    "src17_site_chrome": "with l as (select page_id, regexp_extract(url, '\\.(\\w+)/', 1) as site, unnest(regexp_extract_all(html, '<li><a [^>]*>([^<]*)</a></li>', 1)) as line from pages) select o.site, line, o.n as \"on\", pages from (select site, line, count(distinct page_id) as n from l group by all) o join (select site, count(distinct page_id) as pages from l group by all) p on p.site = o.site where pages >= 4 and o.n >= 0.05 * pages",
    "src19_page_route": f"select doc_id, {_ROUTE} as route from documents",
    "src20_route_histogram": f"select {_ROUTE} as route, count(*) as n from documents group by all",
    "src21_word_rows": "select user_id, cast(row as bigint) as row, count(*) as marks, min(event_id) as first from (select *, sum(case when (epoch_us(ts) - epoch_us(b)) / 1e6 > 21600 then 1 else 0 end) over (partition by user_id order by ts, event_id) as row from (select *, lag(ts) over (partition by user_id order by ts, event_id) as b from events)) group by all",
    "src25_upsert": "select coalesce(s_suppkey, c_custkey) as id, coalesce(c_name, s_name) as name, case when s_suppkey is null then 'added' when c_custkey is null then 'kept' else 'replaced' end as change from supplier full join customer on s_suppkey = c_custkey",
    "src28_render": f"select doc_id, sha256(string_agg(case kind when 'heading_like' then '## ' || line when 'table_row' then '| ' || line else line end, chr(10) || chr(10) order by pos)) as sha, count(*) as n from (select *, {_KIND} as kind from ({_LINES})) where kind <> 'blank' group by doc_id",
    "src29_review_sheet": _o("select record_id, amount, coalesce(nullif(closing_rank, ''), cast(amount as varchar)) as value, coalesce(e.title, '?') as title from records r left join evidence e using (evidence_id) where kind = 'fee' and programme = 'programme-3'", "records", "evidence"),
    "src32_answers": "select conv_id, turn, sha1(q) as question, length(text) as n from (select *, last_value(case when role = 'user' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as q from conversations) where role = 'assistant' and q is not null",
    "src35_token_stream": "select conv_id, turn, pos, cast(sum(length(token)) over (partition by conv_id, turn order by pos) as bigint) as so_far from (select conv_id, turn, unnest(range(len(t))) as pos, unnest(t) as token from (select conv_id, turn, regexp_extract_all(text, '\\S+|\\s+') as t from conversations where role = 'system'))",
}
