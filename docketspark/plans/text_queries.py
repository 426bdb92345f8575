"""Folds, tokens, dates, citations and other scalar functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, dims, scalars, text
from ..operators import normalize
from .registry import LINES, lines, query, sql_build, sql_fold, sql_legal, sql_list, sql_ns, sql_tokens, table


@query(f"SELECT doc_id, md5({sql_ns('text')}) AS norm FROM documents")
def norm_space(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalize_space("text")).alias("norm"))


@query(f"SELECT doc_id, md5({sql_fold('text')}) AS norm FROM documents")
def fold_search(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.fold_search("text")).alias("norm"))


@query(f"SELECT doc_id, md5({sql_build('text')}) AS norm FROM documents")
def fold_build(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.fold_build("text")).alias("norm"))


@query("SELECT doc_id, pos, paragraph_id, section_key, text FROM lines", LINES)
def paragraph_explode(spark, sf):
    return lines(spark, sf).select("doc_id", "pos", "paragraph_id", "section_key", "text")


@query(f"SELECT conv_id, turn, {sql_legal('text')} AS legal FROM conversations")
def legal_fold(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.legal("text").alias("legal"))


_CITED = "concat('Zob. Art. ', l_partkey % 40 + 1, ' ust. ', l_linenumber, '§', l_suppkey % 9 + 1, ' i art.', l_partkey % 7 + 1, ' pkt 2')"


@query(f"SELECT l_orderkey, l_linenumber, {sql_legal(_CITED)} AS legal FROM lineitem")
def legal_canonicalize(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.legal(F.expr(_CITED)).alias("legal"))


@query(
    f"""SELECT l_orderkey, l_linenumber, array_to_string(list_transform(
        regexp_extract_all(lower({_CITED}), 'art\\.?\\s*[0-9]+[a-z]?(\\s*ust\\.?\\s*[0-9]+[a-z]?)?(\\s*§\\s*[0-9]+[a-z]?)?(\\s*pkt\\.?\\s*[0-9]+[a-z]?)?'),
        lambda x: regexp_replace(regexp_replace(x, 'art\\.?\\s*', 'art. '), '\\s*§\\s*', ' § ')), '|') AS cited FROM lineitem"""
)
def citation_extract(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(scalars.citations(F.expr(_CITED)), "|").alias("cited"))


@query(f"SELECT doc_id, len({sql_tokens(sql_build('text'), dims.BIGRAM_STOPWORDS)}) AS n, md5(array_to_string({sql_tokens(sql_build('text'), dims.BIGRAM_STOPWORDS)}, ' ')) AS tokens FROM documents")
def tokenize_filtered(spark, sf):
    toks = text.tokens("text", dims.BIGRAM_STOPWORDS)
    rows = table(spark, sf, "documents").select("doc_id", toks.alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query(f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({sql_tokens(sql_build('text'))}) AS term FROM documents) GROUP BY term")
def term_frequencies(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(text.tokens("text")).alias("term"))
    per = rows.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("m"))
    return per.groupBy("term").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("docs"))


_MONTH = sql_list(("stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca", "lipca", "sierpnia", "września", "października", "listopada", "grudnia"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso,
        CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE year(o_orderdate)::INT END AS year FROM orders"""
)
def polish_date_parse(spark, sf):
    name = F.element_at(F.array(*[F.lit(m) for m in ("stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca", "lipca", "sierpnia", "września", "października", "listopada", "grudnia")]), F.month("o_orderdate"))
    kind = F.col("o_orderkey") % 4
    written = F.when(kind == 0, F.date_format("o_orderdate", "d.M.yyyy")).when(kind == 1, F.concat_ws("  ", F.dayofmonth("o_orderdate").cast("string"), name, F.year("o_orderdate").cast("string"))).when(kind == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("maj 2020")
    date = scalars.parse_date(written)
    return table(spark, sf, "orders").select("o_orderkey", date["iso"].alias("iso"), date["year"].alias("year"))


@query(
    """SELECT l_orderkey AS document_id, count(DISTINCT l_suppkey) AS judges,
        CASE WHEN judges >= 11 THEN 'pelny_sklad' WHEN judges = 5 THEN 'piecioosobowa' WHEN judges = 3 THEN 'trojosobowa' ELSE judges || '_osobowa' END AS bench,
        CASE WHEN judges >= 11 OR judges IN (3, 5) THEN bench ELSE 'poza_klasyfikacja_ipo' END AS official FROM lineitem GROUP BY l_orderkey"""
)
def bench_classify(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.countDistinct("l_suppkey").alias("judges"))
    own = classify.bench(F.col("judges"))["key"]
    return n.select("document_id", "judges", own.alias("bench"), classify.official_bench(own)["key"].alias("official"))


_TYPES = {"1-URGENT": "Postanowienie tymczasowe", "2-HIGH": "Wyrok", "3-MEDIUM": "Postanowienie - umorzenie", "4-NOT SPECIFIED": "Uchwała", "5-LOW": "Rozstrzygnięcie"}


@query(
    """SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'postanowienie_tymczasowe' WHEN '2' THEN 'wyrok' WHEN '3' THEN 'postanowienie' WHEN '5' THEN 'rozstrzygniecie' END AS type_key,
        left(o_orderpriority, 1) <> '4' AS visible FROM orders"""
)
def type_classify(spark, sf):
    named = scalars.one_of(F.col("o_orderpriority"), _TYPES, "Uchwała")
    kind = classify.decision_type(named)
    return table(spark, sf, "orders").select("o_orderkey", kind["key"].alias("type_key"), kind["visible"].alias("visible"))


@query(
    """SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'pelny_sklad' WHEN l.quality = 0 THEN 'trojosobowa' END,
        CASE WHEN doc_id % 13 >= 11 THEN 'pelny_sklad' WHEN doc_id % 13 = 5 THEN 'piecioosobowa' WHEN doc_id % 13 = 3 THEN 'trojosobowa' ELSE 'poza_klasyfikacja_ipo' END) AS bench
        FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def bench_override(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 13).cast("int").alias("judge_count"))
    known = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "pelny_sklad").when(F.col("quality") == 0, "trojosobowa").alias("bench"))
    return normalize.with_bench(rows, known, key="doc_id").select("doc_id", F.col("bench_size_ipo_key").alias("bench"))


_HEADINGS = ("Komparycja", "Tenor orzeczenia", "Zdanie odrębne", "ORZEKA", "Umorzyć postępowanie", "Sentencja", "Uzasadnienie - część historyczna", "Uzasadnienie na rozprawie", "Uzasadnienie prawne", "Uzasadnienie", "Część na rozprawie", "xyz")
_SECTIONS = ("komparycja", "tenor", "zdanie_odrebne", "orzeka", "postanawia", "sentencja_inna", "uzasadnienie_historyczne", "uzasadnienie_postepowanie", "uzasadnienie_prawne", "uzasadnienie_ogolne", "uzasadnienie_postepowanie", "inne")


@query(f"SELECT p_partkey, {sql_list(_SECTIONS)}[p_partkey % 12 + 1] AS section FROM part")
def section_from_heading(spark, sf):
    heading = F.element_at(F.array(*map(F.lit, _HEADINGS)), (F.col("p_partkey") % 12 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", classify.section_of(heading).alias("section"))


@query("SELECT p_partkey, ['I', 'IV', 'XII', NULL][p_partkey % 4 + 1] AS roman FROM part")
def roman_prefix(spark, sf):
    written = F.element_at(F.array(*map(F.lit, ("I - wstęp", "iv. część", "XII", "Inne"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", scalars.roman(written).alias("roman"))


@query("SELECT c_custkey, c_nationkey, upper(regexp_extract(c_name, '^([A-Za-z]{1,4})([^A-Za-z0-9_]|$)', 1)) AS repertory FROM customer")
def signature_repertory(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", scalars.repertory("c_name").alias("repertory"))


@query(
    """SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(greatest(0, 1 - least(abs(a.n_nationkey - b.n_nationkey), 20) / 20.0), 6)::DOUBLE AS proximity FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey"""
)
def year_proximity(spark, sf):
    n = table(spark, sf, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), "n_regionkey"), n.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    return a.join(b, "n_regionkey").select("a", "b", F.round(scalars.year_proximity(F.col("a"), F.col("b")), 6).alias("proximity"))


@query(
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://ipo.trybunal.gov.pl/ipo/Sprawa?dokument=' || page_id || '&sprawa=' || page_id % 10 ELSE url END AS canonical,
        page_id % 3 = 0 AS official FROM pages"""
)
def url_canonical(spark, sf):
    given = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://ipo.trybunal.gov.pl/ipo/Sprawa?cid=1&dokument="), "page_id", F.lit("&sprawa="), F.col("page_id") % 10)).otherwise(F.col("url"))
    none = F.lit(None).cast("string")
    rows = table(spark, sf, "pages").select("page_id", scalars.canonical_url(given, none, none).alias("canonical"))
    return rows.withColumn("official", F.coalesce(F.try_parse_url("canonical", F.lit("HOST")) == dims.PORTAL_HOST, F.lit(False)))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CASE WHEN length(p_type) > 12 THEN rtrim(left(p_type, 12)) || '...' ELSE p_type END AS short FROM part")
def slug_and_truncate(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"), text.truncate(F.col("p_type"), 12).alias("short"))


@query("SELECT p_partkey, p_size, CASE WHEN p_size = 1 THEN 'wyrok' WHEN p_size % 10 BETWEEN 2 AND 4 AND NOT p_size % 100 BETWEEN 12 AND 14 THEN 'wyroki' ELSE 'wyroków' END AS form FROM part")
def plural_forms(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size", text.plural(F.col("p_size"), "wyrok", "wyroki", "wyroków").alias("form"))


@query("SELECT doc_id, ((length(text) - length(replace(text, 'th', ''))) / 2)::INT AS n FROM documents")
def count_occurrences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.occurrences(F.col("text"), "th").alias("n"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[",\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM conversations""")
def csv_quote(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.csv_field("text").alias("field"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped FROM pages""")
def html_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.escape_html("html")).alias("escaped"))


@query(
    f"""SELECT paragraph_id, (length(text) <= 140 AND len(string_split(text, ' ')) <= 12 AND NOT regexp_matches(lower(text), '(^|[^a-z0-9_])art\\.?\\s*[0-9]') AND (
        (regexp_matches(lower(text), '^([0-9]+|[ivxlcdm]+)[.)]\\s+') AND regexp_matches(text, '[.:]$')) OR (regexp_matches(text, '^§\\s*[0-9]+') AND regexp_matches(text, '[.:]$'))
        OR (regexp_matches(text, '^[\\p{{L}}\\p{{N}}\\s–,-]+[:.]$') AND len(string_split(text, ' ')) <= 8)
        OR (regexp_matches({sql_build('text')}, '^(przedmiot|stan faktyczny|ocena|uzasadnienie|konkluzja|wniosek)([^A-Za-z0-9_]|$)') AND regexp_matches(text, '[.:]$')))) AS heading FROM lines""",
    LINES,
)
def heading_like(spark, sf):
    return lines(spark, sf).select("paragraph_id", classify.heading_like("text").alias("heading"))


@query("SELECT r_regionkey, sha256(r_name) AS h, sha256(string_agg(r_name, '|') OVER (ORDER BY r_regionkey)) AS running FROM region")
def sha_digest(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy("r_regionkey")  # five rows
    return table(spark, sf, "region").select("r_regionkey", F.sha2("r_name", 256).alias("h"), F.sha2(F.array_join(F.collect_list("r_name").over(w), "|"), 256).alias("running"))
