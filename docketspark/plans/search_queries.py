"""The search language, scoring, grouping, snippets, contexts and the lemma index over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dims, text
from ..operators import lemma, normalize, phrases, search, segments, trigram
from ..operators.query import Filters, parse
from ..sources.shared import scratch
from .registry import INDEX, KEYS, LINES, index, lines, query, sql_build, sql_case, sql_count, sql_fold, sql_list, sql_tokens, table

WEIGHT = sql_case("section_key", dims.SEARCH_WEIGHTS, 1.0)


def _found(spark, sf, q, *keep):
    return search.hits(index(spark, sf), parse(q)).select("paragraph_id", *keep)


@query("SELECT paragraph_id FROM idx WHERE contains(t, 'heed')", INDEX)
def search_term(spark, sf):
    return _found(spark, sf, "Héed")


@query("SELECT paragraph_id FROM idx WHERE contains(t, 'of the')", INDEX)
def search_phrase(spark, sf):
    return _found(spark, sf, '"of  the"')


@query("SELECT paragraph_id FROM idx WHERE (contains(t, 'there') OR contains(t, 'que la')) AND contains(t, 'ion')", INDEX)
def search_boolean(spark, sf):
    return _found(spark, sf, '(there OR "que la") ion')


@query(f"SELECT paragraph_id, round(greatest({sql_count('t', 'heon')} + {sql_count('t', 'que la')}, 1) * {WEIGHT} + CASE WHEN contains(t, 'que la') THEN 1.4 ELSE 0 END, 3)::DOUBLE AS score FROM idx WHERE (contains(t, 'heon') OR contains(t, 'que la')) AND year >= 1995", INDEX)
def search_trigram(spark, sf):
    """Over a written index of trigrams: blocks that cannot match are not read."""
    place = scratch(spark, "trigrams")
    trigram.write(index(spark, sf).drop("paragraph_index", "document_id"), place, ["doc_id", "pos"])
    return trigram.search(spark, place, parse('heon OR "que la"'), Filters(year_from=1995)).select("paragraph_id", "score")


@query("SELECT paragraph_id FROM idx WHERE contains(t, 'tion') AND NOT (contains(t, 'the') OR contains(t, 'der'))", INDEX)
def search_not(spark, sf):
    return _found(spark, sf, "tion and not (the or der)")


@query("SELECT paragraph_id FROM idx WHERE contains(t, 'an') AND year BETWEEN 1995 AND 2003", INDEX)
def search_field_year(spark, sf):
    return _found(spark, sf, "an rok:2003-1995")


@query("SELECT paragraph_id FROM idx WHERE contains(t, 'en') AND section_key IN ('tenor', 'orzeka', 'postanawia') AND NOT section_key = 'orzeka'", INDEX)
def search_field_section(spark, sf):
    return _found(spark, sf, 'en sekcja:"holding only" NOT sekcja:orzeka')


@query("SELECT paragraph_id FROM idx WHERE contains(source, 'src1') AND contains(t, 'es')", INDEX)
def search_field_judge(spark, sf):
    return _found(spark, sf, "sędzia:SRC1 es")


@query("SELECT paragraph_id FROM idx WHERE contains(signature, 'k 7/') AND contains(lang, 'en')", INDEX)
def search_field_signature(spark, sf):
    return _found(spark, sf, 'sygn:"K 7/" teza:en')


@query(f"SELECT paragraph_id, round(greatest({sql_count('t', 'the')} + {sql_count('t', 'of the')}, 1) * {WEIGHT} + CASE WHEN contains(t, 'of the') THEN 1.4 ELSE 0 END, 3)::DOUBLE AS score FROM idx WHERE contains(t, 'the') OR contains(t, 'of the')", INDEX)
def search_score(spark, sf):
    return _found(spark, sf, 'the OR "of the"', "score")


_HITS = INDEX + f""", hits AS (SELECT *, round(greatest({sql_count('t', 'tion')} + {sql_count('t', 'der')}, 1) * {WEIGHT}, 3)::DOUBLE AS score FROM idx WHERE contains(t, 'tion') OR contains(t, 'der')),
    groups AS (SELECT doc_id, signature, count(*) AS hit_count, max(score) AS top_score FROM hits GROUP BY ALL)"""


@query("SELECT doc_id, signature, hit_count, top_score FROM groups ORDER BY top_score DESC, signature, doc_id LIMIT 10", _HITS)
def search_grouped_topk(spark, sf):
    found = search.hits(index(spark, sf), parse("tion OR der"))
    groups = search.cases_of(found, ["doc_id", "signature"])
    return search.page(groups, [F.col("top_score").desc(), F.col("signature"), F.col("doc_id")])


@query("SELECT doc_id, signature, hit_count, top_score FROM groups ORDER BY top_score DESC, signature, doc_id LIMIT 10 OFFSET 10", _HITS)
def search_page2(spark, sf):
    groups = search.cases_of(search.hits(index(spark, sf), parse("tion OR der")), ["doc_id", "signature"])
    return search.page(groups, [F.col("top_score").desc(), F.col("signature"), F.col("doc_id")], 2)


@query("SELECT doc_id, paragraph_id, score, hit_rank::INT AS hit_rank FROM (SELECT doc_id, paragraph_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos, paragraph_id) AS hit_rank FROM hits) WHERE hit_rank <= 3", _HITS)
def search_top3_hits(spark, sf):
    found = search.grouped(search.hits(index(spark, sf), parse("tion OR der")), "doc_id", ("pos", "paragraph_id"))
    return found.where(F.col("hit_rank") <= dims.HITS_PER_CASE).select("doc_id", "paragraph_id", "score", "hit_rank")


@query("SELECT DISTINCT doc_id, signature, year FROM lines WHERE year >= 2010 AND contains(source, 'src0') ORDER BY year DESC, signature, doc_id LIMIT 10", LINES)
def browse_mode(spark, sf):
    rows = index(spark, sf).where(Filters(year_from=2010, judge="SRC0").condition()).select("doc_id", "signature", "year").distinct()
    return search.page(rows, [F.col("year").desc(), F.col("signature"), F.col("doc_id")])


@query("SELECT paragraph_id FROM idx WHERE year BETWEEN 1992 AND 2016 AND section_key = 'zdanie_odrebne' AND contains(signature, '/3') AND contains(t, 'a')", INDEX)
def search_facets(spark, sf):
    f = Filters.preset("dissent")
    f = Filters(sections=f.sections, year_from=1992, year_to=2016, signature="/3")
    return search.hits(index(spark, sf), parse("a"), f).select("paragraph_id")


@query("SELECT lang, count(*) FILTER (contains(t, 'the') AND contains(t, 'and')) AS matching, count(*) AS total FROM idx GROUP BY lang", INDEX)
def layer_filter_coverage(spark, sf):
    rows = index(spark, sf)
    blob = F.col("text_legal")
    return rows.groupBy("lang").agg(F.count_if(blob.contains("the") & blob.contains("and")).alias("matching"), F.count(F.lit(1)).alias("total"))


@query("SELECT count(*) FILTER (contains(t, 'the')) AS matching, count(*) AS total, round(100 * count(*) FILTER (contains(t, 'the')) / count(*), 1) AS percent FROM idx", INDEX)
def coverage_percent(spark, sf):
    return search.coverage(index(spark, sf), F.col("text_legal").contains("the"))


_SNIP = """CASE WHEN length(text) <= 120 THEN text WHEN hit = 0 THEN rtrim(left(text, 120)) || '...'
    ELSE (CASE WHEN s > 0 THEN '...' ELSE '' END) || trim(substr(text, s + 1, 120)) || (CASE WHEN s + 120 < length(text) THEN '...' ELSE '' END) END"""


@query(
    f"""SELECT paragraph_id, {_SNIP} AS snippet FROM (SELECT *, greatest(hit - 1 - 40, 0) AS s FROM (SELECT *, CASE WHEN a = 0 THEN b WHEN b = 0 THEN a ELSE least(a, b) END AS hit
        FROM (SELECT *, strpos(t, 'tion') AS a, strpos(t, 'ere') AS b FROM idx)))""",
    INDEX,
)
def snippet_window(spark, sf):
    return search.with_snippet(index(spark, sf), parse("tion ere"), "text", 120, 40).select("paragraph_id", "snippet")


@query("SELECT conv_id, turn, lag(role) OVER w AS prev_role, lag(text) OVER w AS prev_text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def context_prev_next(spark, sf):
    return search.context(table(spark, sf, "conversations"), "conv_id", "turn", ["role", "text"]).select("conv_id", "turn", "prev_role", "prev_text", "next_role", "next_text")


_TURNS = "turns AS (SELECT conv_id, turn, text, CASE role WHEN 'system' THEN 'komparycja' WHEN 'user' THEN 'inne' ELSE ['tenor', 'orzeka'][conv_id % 2 + 1] END AS section_key FROM conversations)"


def _turns(spark, sf):
    key = F.when(F.col("role") == "system", "komparycja").when(F.col("role") == "user", "inne").otherwise(F.when(F.col("conv_id") % 2 == 0, "tenor").otherwise("orzeka"))
    return table(spark, sf, "conversations").select("conv_id", "turn", "text", key.alias("section_key"))


@query(
    """SELECT conv_id, turn, last_value(k IGNORE NULLS) OVER b AS prev_key, (n - last_value(CASE WHEN k IS NOT NULL THEN n END IGNORE NULLS) OVER b)::INT AS prev_distance,
        first_value(k IGNORE NULLS) OVER a AS next_key, (first_value(CASE WHEN k IS NOT NULL THEN n END IGNORE NULLS) OVER a - n)::INT AS next_distance
        FROM (SELECT *, nullif(section_key, 'inne') AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM turns)
        WINDOW b AS (PARTITION BY conv_id ORDER BY n ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY conv_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)""",
    _TURNS,
)
def neighbor_known_section(spark, sf):
    return normalize.neighbours(_turns(spark, sf), "conv_id", "turn").select("conv_id", "turn", "prev_key", "prev_distance", "next_key", "next_distance")


@query("SELECT conv_id, turn, sum(CASE WHEN section_key = 'inne' AND length(text) <= 220 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS island FROM turns", _TURNS)
def dissent_islands(spark, sf):
    return normalize.islands(_turns(spark, sf), "conv_id", "turn", (F.col("section_key") == "inne") & (F.length("text") <= 220)).select("conv_id", "turn", "island")


@query("SELECT conv_id, turn, prev_key, next_key, position_ratio FROM (SELECT *, lag(section_key) OVER w AS prev_key, lead(section_key) OVER w AS next_key, round(row_number() OVER w / count(*) OVER (PARTITION BY conv_id), 4) AS position_ratio FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE section_key = 'inne'", _TURNS)
def unknown_candidates(spark, sf):
    return normalize.unknown_candidates(_turns(spark, sf), "conv_id", "turn").select("conv_id", "turn", "prev_key", "next_key", "position_ratio")


@query(
    """SELECT conv_id, turn, CASE WHEN section_key = 'inne' AND turn % 3 = 0 THEN 'tenor' ELSE section_key END AS section_key, section_key = 'inne' AND turn % 3 = 0 AS used FROM turns""",
    _TURNS,
)
def prediction_merge(spark, sf):
    rows = _turns(spark, sf).withColumn("paragraph_id", F.concat_ws("-", "conv_id", "turn"))
    kind = F.col("turn") % 3
    said = rows.select("paragraph_id", F.when(kind == 2, "no such section").otherwise("tenor").alias("predicted_section_key"), F.when(kind == 1, 0.6).otherwise(0.9).alias("confidence"))
    return normalize.merge_predictions(rows, said).select("conv_id", "turn", "section_key", F.col("predicted_used").alias("used"))


@query()
def section_fold(spark, sf):
    """The left-to-right reclassification; SQL can't look back at its own decisions. Tests compare it with FIXTURES."""
    rows = _turns(spark, sf).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "section_key", "text"))).alias("p"))
    none = F.lit(None).cast("string")
    shaped = F.transform("p", lambda p, i: F.struct(F.concat_ws("-", F.col("conv_id"), p["turn"]).alias("paragraph_id"), (i + 1).cast("int").alias("paragraph_index"), none.alias("paragraph_number"), p["section_key"].alias("section_key"), none.alias("section_label"), F.lit(0.35).alias("section_confidence"), none.alias("section_raw"), p["text"].alias("text"), none.alias("a"), none.alias("b")))
    walked = rows.select("conv_id", normalize.walk(shaped.cast(normalize.PARAGRAPHS), F.lit("Wyrok"), F.lit(True)).alias("p"))
    return walked.select("conv_id", F.inline("p")).select("conv_id", "paragraph_id", "section_key", "section_confidence", "section_reclass_reason")


@query(
    f"""SELECT issue, source, string_agg(paragraph_id, ' | ' ORDER BY pos, paragraph_id) AS cell FROM (SELECT issue, source, paragraph_id, pos, row_number() OVER (PARTITION BY issue, source ORDER BY pos, paragraph_id) AS rank
        FROM (SELECT *, unnest(['the', 'que', 'der']) AS issue, {sql_fold('text')} AS f FROM lines) WHERE contains(f, issue)) WHERE rank <= 4 GROUP BY issue, source""",
    LINES,
)
def argument_matrix(spark, sf):
    rows = lines(spark, sf).withColumns({"text_fold": text.fold_search("text"), "place": F.struct("pos", "paragraph_id")})
    return search.argument_matrix(rows, ["the", "que", "der"], "source", "paragraph_id", "place")


@query(
    f"""SELECT term, count(*) AS count FROM (SELECT unnest(string_split_regex({sql_fold('text')}, '[^\\p{{L}}\\p{{N}}]+')) AS term FROM lines) WHERE length(term) >= 4
        AND NOT list_contains({sql_list(dims.SIDEBAR_STOPWORDS + ('tion',))}, term) GROUP BY term ORDER BY count DESC, term LIMIT 24""",
    LINES,
)
def sidebar_terms(spark, sf):
    return search.sidebar_terms(lines(spark, sf), "text", parse("tion"))


@query()
def highlights(spark, sf):
    """Ranges to mark, and the text with the marks; offsets are found in Python, tests hold them against plain search."""
    rows = search.with_highlights(index(spark, sf), parse('tion "of the"'))
    return rows.select("paragraph_id", F.size("highlights").alias("n"), F.md5(search.marked(F.col("text"), F.col("highlights"))).alias("marked"))


@query()
def heading_merge(spark, sf):
    """Ranked hits with headings merged into the hit behind them; tests hold it against a plain loop."""
    found = search.grouped(search.hits(index(spark, sf), parse("e")), "document_id")
    return search.merge_headings(found).select("paragraph_id", "hit_rank", "merged_heading")


@query()
def quote_tokens(spark, sf):
    """Word spans as written."""
    return search.word_spans(lines(spark, sf), "text", ["paragraph_id"]).groupBy("paragraph_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


# --- lemma index: a form's lemma is its first five letters, in both engines ---

_TOKS = INDEX + """, toks AS (SELECT paragraph_id, form, left(form, 5) AS lemma, i - 1 AS pos FROM (SELECT paragraph_id, unnest(f) AS form, unnest(range(1, len(f) + 1)) AS i
    FROM (SELECT paragraph_id, list_filter(string_split_regex(t, '[^\\p{L}\\p{N}_-]+'), lambda x: x <> '') AS f FROM idx)))"""
_KEY = ["paragraph_id"]


def _lemma(form):
    """The dictionary as an expression."""
    return F.substring(form, 1, 5)


@query("SELECT lemma, count(DISTINCT paragraph_id) AS paragraphs, md5(string_agg(DISTINCT paragraph_id, ',' ORDER BY paragraph_id)) AS digest FROM toks GROUP BY lemma", _TOKS)
def lemma_postings(spark, sf):
    rows = lemma.lemmas_of(lines(spark, sf), _lemma, "text", _KEY, spaced=True)
    ids = rows.groupBy("lemma").agg(F.array_distinct(F.sort_array(F.collect_list("paragraph_id"))).alias("ids"))
    return ids.select("lemma", F.size("ids").cast("long").alias("paragraphs"), F.md5(F.array_join("ids", ",")).alias("digest"))


@query("SELECT lemma, count(DISTINCT paragraph_id) AS paragraphs, count(*) AS places FROM toks WHERE paragraph_id NOT IN (SELECT paragraph_id FROM idx WHERE doc_id IN (SELECT doc_id FROM labels)) GROUP BY lemma", _TOKS)
def lemma_segments(spark, sf):
    """An index of four segments, merged, from which the labelled documents are removed."""
    place, rows = scratch(spark, "segments"), lines(spark, sf)
    for part in range(4):
        segments.add(spark, place, rows.where(F.pmod("doc_id", F.lit(4)) == part), _lemma, key=["doc_id", "paragraph_id"], spaced=True)
    segments.remove(spark, place, table(spark, sf, "labels"), "doc_id")
    segments.merge(spark, place, "doc_id")
    found = segments.positions(spark, place, "doc_id")
    return found.groupBy("lemma").agg(F.countDistinct("paragraph_id").alias("paragraphs"), F.count(F.lit(1)).alias("places"))


@query("SELECT lemma, paragraph_id, array_to_string(list_sort(list_distinct(list(pos))), ',') AS positions FROM toks GROUP BY lemma, paragraph_id", _TOKS)
def lemma_positions(spark, sf):
    return lemma.packed_rows(lines(spark, sf), _lemma, "text", _KEY, spaced=True).select("lemma", "paragraph_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("SELECT DISTINCT paragraph_id FROM toks WHERE lemma = 'the' INTERSECT SELECT paragraph_id FROM toks WHERE lemma = 'and'", _TOKS)
def lemma_and(spark, sf):
    return phrases.rows_with(lines(spark, sf), [["the"], ["and"]], _lemma).select(*_KEY)


@query("SELECT DISTINCT a.paragraph_id FROM toks a JOIN toks b USING (paragraph_id) WHERE a.lemma = 'of' AND b.lemma = 'the' AND b.pos = a.pos + 1", _TOKS)
def lemma_phrase2(spark, sf):
    return phrases.rows_with(lines(spark, sf), [["of", "the"]], _lemma).select(*_KEY)


@query("SELECT DISTINCT a.paragraph_id FROM toks a JOIN toks b USING (paragraph_id) JOIN toks c USING (paragraph_id) WHERE a.lemma = 'the' AND b.lemma = 'of' AND b.pos = a.pos + 1 AND c.lemma = 'the' AND c.pos = a.pos + 2", _TOKS)
def lemma_phrase3(spark, sf):
    return phrases.rows_with(lines(spark, sf), [["the", "of", "the"]], _lemma).select(*_KEY)


@query("SELECT paragraph_id FROM idx WHERE paragraph_id IN (SELECT paragraph_id FROM toks WHERE lemma = 'the') AND paragraph_id NOT IN (SELECT a.paragraph_id FROM toks a JOIN toks b USING (paragraph_id) WHERE a.lemma = 'of' AND b.lemma = 'the' AND b.pos = a.pos + 1)", _TOKS)
def lemma_search(spark, sf):
    return phrases.search(index(spark, sf), parse('the NOT "of the"'), _lemma).select(*_KEY)


@query("SELECT form, lemma FROM toks GROUP BY form, lemma", _TOKS)
def lemma_forms(spark, sf):
    return lemma.occurrences(lines(spark, sf), "text", _KEY, spaced=True).select("form", _lemma("form").alias("lemma")).distinct()


@query('SELECT shard, min(form) AS "from", max(form) AS "to", count(*) AS n FROM (SELECT form, ((row_number() OVER (ORDER BY form) - 1) // 1000)::INT AS shard FROM (SELECT DISTINCT form FROM toks)) GROUP BY shard', _TOKS)
def shard_ranges(spark, sf):
    return lemma.shards(lemma.occurrences(lines(spark, sf), "text", _KEY, spaced=True), "form", 1000)
