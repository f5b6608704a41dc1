"""Named queries over the test tables, with the same results in SQL where SQL has what it takes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import preset
from ..functions import html, lexer, links, morphology, normalize, splitter
from ..operators import classify, embeddings, features, sampling, sentences
from ..operators.durable import shared_dir, stored
from ..sources import tables
from . import pipelines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
NAME_WORDS = r"[a-z]+"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """rows over four tasks a core: a small file is few splits, however long its rows keep Python busy. The number is
    given, so that adaptive execution does not put the small partitions together again."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors see."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Lexer features: text built from columns, and the tokens it must give, in SQL that both engines read.
_P, _O, _C = ("part", "p_partkey"), ("orders", "o_orderkey"), ("customer", "c_custkey")
_SIZE, _KEY = "CAST(p_size AS VARCHAR(9))", "CAST(o_orderkey AS VARCHAR(20))"
_MOD = lambda n: f"CAST(p_size % {n} AS VARCHAR(9))"
_PICK = lambda *v: "CASE p_size % " + str(len(v)) + "".join(f" WHEN {i} THEN '{x}'" for i, x in enumerate(v)) + " END"

TOKENS: dict[str, tuple[tuple[str, str], str, str]] = {
    "CUSTOMTOKEN": (_P, "'see __' || " + _PICK("uri", "email") + " || '__ ok'", "'see <' || upper(" + _PICK("uri", "email") + ") || '> ok'"),
    "REPLY": (_P, _PICK("", ".", " . ") + " || '@bob hi'", _PICK("", "<PUBLIC> ", "<PUBLIC> ") + " || '<REPLY> <MENTION> hi'"),
    "CENSORED": (_P, "'a b' || repeat('*', p_size % 4 + 1) || 'd word'", "'a b' || repeat('*', p_size % 4 + 1) || 'd word'"),
    "EMPHASIS_B": (_P, "'i ' || repeat('*', p_size % 3 + 1) || 'love' || '* it'", "'i <EMPHASIS_B> love it'"),
    "EMPHASIS_U": (_P, "'i _' || " + _PICK("hate", "love") + " || '_ it'", "'i <EMPHASIS_U> ' || " + _PICK("hate", "love") + " || ' it'"),
    "TIMEOFDAY": (_P, "'at ' || " + _MOD(10) + " || ':30 pm now'", "'at <TIMEOFDAY> ' || " + _MOD(10) + " || ':30PM now'"),
    "DATE": (_P, "'on ' || " + _SIZE + " || '/4/07 then'", "'on <DATE> then'"),
    "EMOTIC_EAST_LO": (_P, "'so ' || " + _PICK("(^_^)", "*_*", "-.-") + " || ' ok'", "'so ' || " + _PICK("(^_^)", "*_*", "-.-") + " || ' ok'"),
    "EMOTIC_EAST_HI": (_P, "'so ' || " + _PICK("^-^", "^o^") + " || ' ok'", "'so ' || " + _PICK("^-^", "^o^") + " || ' ok'"),
    "EMOTIC_EAST_SAD": (_P, "'so ' || " + _PICK("t_t", "q.q", ";_;") + " || ' ok'", "'so <EMOTIC_EAST_SAD> ' || " + _PICK("t_t", "q.q", ";_;") + " || ' ok'"),
    "EMOTIC_WEST_L": (_P, "'so ' || " + _PICK(":-)", ":(", ":o") + " || ' ok'", "'so ' || " + _PICK(":-) <EMOTIC_WEST_HAPPY>", ":( <EMOTIC_WEST_SAD>", ":o <EMOTIC_WEST>") + " || ' ok'"),
    "EMOTIC_WEST_R": (_P, "'so ' || " + _PICK("(:", "):", "(=") + " || ' ok'", "'so ' || " + _PICK("(: <EMOTIC_WEST_HAPPY>", "): <EMOTIC_WEST_SAD>", "(= <EMOTIC_WEST_HAPPY>") + " || ' ok'"),
    "EMOTIC_WEST_CHEER": (_P, "'so ' || chr(92) || " + _PICK("o", "m") + " || '/ ok'", "'so ' || chr(92) || " + _PICK("o", "m") + " || '/ ok'"),
    "EMOTIC_WEST_L_MISC": (_P, "'so ' || " + _PICK(":3", ":@", "=$") + " || ' ok'", "'so ' || " + _PICK(":3 <EMOTIC_WEST_HAPPY>", ":@ <EMOTIC_WEST_SAD>", "=$ <EMOTIC_WEST_HAPPY>") + " || ' ok'"),
    "EMOTIC_WEST_R_MISC": (_P, "'so ' || " + _PICK("$:", "@=") + " || ' ok'", "'so ' || " + _PICK("$: <EMOTIC_WEST_HAPPY>", "@= <EMOTIC_WEST_SAD>") + " || ' ok'"),
    "EMOTIC_RUSS_HAPPY": (_P, "'ha ' || repeat(')', p_size % 5 + 2) || ' ok'", "'ha ' || repeat(')', p_size % 5 + 2) || ' ok'"),
    "EMOTIC_RUSS_SAD": (_P, "'oh ' || repeat('(', p_size % 5 + 2) || ' ok'", "'oh ' || repeat('(', p_size % 5 + 2) || ' ok'"),
    "EMOTIC_HEART": (_P, "'i ' || " + _PICK("<3", "</3") + " || ' it'", "'i ' || " + _PICK("<3 <EMOTIC_HEART_HAPPY>", "</3 <EMOTIC_HEART_SAD>") + " || ' it'"),
    "CONTRACTION": (_P, _PICK("she''s", "isn''t", "won''t", "can''t", "abr''ac") + " || ' ok'", _PICK("she ''s", "is n''t", "will n''t", "can n''t", "abr ac") + " || ' ok'"),
    "STARRATING": (_P, "'it is ' || " + _MOD(11) + " || ' out of 10'", "'it is <' || " + _MOD(11) + " || '/10>'"),
    "STARRATING_FULL": (_P, "'rate a full 10 ' || " + _PICK("x", "y"), "'rate a <10/10> ' || " + _PICK("x", "y")),
    "STARRATING_X": (_P, "'give it a ' || " + _MOD(10) + " || ' star rating'", "'give it <' || " + _MOD(10) + " || '/10>'"),
    "MPAARATING": (_P, "'it is ' || " + _PICK("pg-13", "nc-17", "pg 13") + " || ' rated'", "'it is ' || " + _PICK("<PG13>", "<NC17>", "<PG13>") + " || ' rated'"),
    "GRADE_POST": (_P, "'my grade: ' || " + _PICK("a", "b+", "f") + " || ' !'", "'my <GRADE_' || upper(" + _PICK("a", "b+", "f") + ") || '> !'"),
    "GRADE_PRE": (_P, "'dull ' || " + _PICK("b", "c+") + " || '-grade film'", "'dull <GRADE_' || upper(" + _PICK("b", "c+") + ") || '> film'"),
    "THREED": (_P, "'in ' || " + _PICK("3d", "3-d") + " || ' now'", "'in <3D> now'"),
    "DECADE": (_P, "'the ' || " + _PICK("1950s", "60''s", "1980''s") + " || ' style'", "'the ' || " + _PICK("1950s", "60s", "1980s") + " || ' style'"),
    "NUMBER": (_O, "'no ' || " + _KEY + " || ' item'", "'no <NUM> <NUM_' || CAST(length(" + _KEY + ") AS VARCHAR(9)) || '> item'"),
    "HASHTAG": (_C, "'go #' || lower(c_mktsegment) || ' now'", "'go <HASHTAG> #' || lower(c_mktsegment) || ' ' || lower(c_mktsegment) || ' now'"),
    "MENTION": (_C, "'ask @' || lower(c_mktsegment) || ' now'", "'ask <MENTION> now'"),
    "ASCIIARROW_R": (_P, "'go ' || " + _PICK("-->", "==>", ">>") + " || ' on'", "'go <ASCIIARROW_R> on'"),
    "ASCIIARROW_L": (_P, "'go ' || " + _PICK("<--", "<<<", "<==") + " || ' on'", "'go <ASCIIARROW_L> on'"),
    "MNDASH": (_P, "'a' || " + _PICK(" - ", "--", "---", "–", "—") + " || 'dog'", "'a ' || " + _PICK("-", "--", "---", "--", "---") + " || ' dog'"),
    "ABBREV1": (_P, "'the ' || " + _PICK("s&p", "w/o", "a+b") + " || ' list'", "'the ' || " + _PICK("s&p", "w/o", "a+b") + " || ' list'"),
    "ABBREV2": (_P, "'the ' || " + _PICK("x-men", "t-trak") + " || ' list'", "'the ' || " + _PICK("x-men", "t-trak") + " || ' list'"),
    "ABBREV3": (_P, "'the ' || " + _PICK("u.s.", "d.c.") + " || ' list'", "'the ' || " + _PICK("u.s.", "d.c.") + " || ' list'"),
    "ELLIPSIS": (_P, "'wait' || repeat('.', p_size % 4 + 2) || 'what'", "'wait ' || repeat('.', p_size % 4 + 2) || ' what'"),
    "XOXO": (_P, "'bye ' || " + _PICK("xo xo", "xoxo") + " || ' dear'", "'bye <XOXO> XOXO dear'"),
    "XX": (_P, "'bye ' || " + _PICK("x x x", "xxx") + " || ' dear'", "'bye <XX> XXX dear'"),
    "PUNKT": (_P, "'so' || repeat('!', p_size % 3 + 1) || ' yes, no'", "'so ' || repeat('!', p_size % 3 + 1) || ' yes , no'"),
    "ANYWORD": (_P, "lower(p_name)", "array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9_]+'), ' ')"),
}


def _token_query(feature: str) -> None:
    (name, key), text, tokens = TOKENS[feature]

    @query(f"SELECT {key} AS id, {tokens} AS tokens FROM {name}", f"tok_{feature.lower()}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = dealt(table(spark, sf_dir, name)).select(F.col(key).alias("id"), F.expr(text).alias("text"))
        kind = "twitter" if feature in ("NUMBER", "REPLY", "HASHTAG", "MENTION", "XX") else "reviews"
        return rows.select("id", F.concat_ws(" ", lexer.tokens("text", kind)).alias("tokens"))


for _feature in TOKENS:
    _token_query(_feature)


def text_query(name: str, source: tuple[str, str], text: str, expected: str, f: Callable) -> None:
    """f(Column) of a text built from columns; the result is `out`."""
    tab, key = source

    @query(f"SELECT {key} AS id, {expected} AS out FROM {tab}", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = dealt(table(spark, sf_dir, tab)).select(F.col(key).alias("id"), F.expr(text).alias("text"))
        return rows.select("id", f("text").alias("out"))


_U = ("pages", "page_id")
_HOST = "regexp_extract(url, '://([^/?#]*)', 1)"
text_query("strip_html", _P, "'<p>' || p_name || '<br>' || p_brand || '</p>'", "p_name || chr(10) || p_brand", html.strip_html)
text_query("unescape_entities", _P, "p_name || '&lt;3 &amp; &#65;&bad; &apos;'", "p_name || '<3 & A&bad; '''", html.unescape_entities)
text_query("nfkc", _P, "'\ufb01' || p_name || '\uff21'", "'fi' || p_name || 'A'", normalize.unicode_form)
text_query("translate_chars", _P, "'\uff21' || p_name || '\u200b\u00a0\u201c\u24d0'", "'A' || p_name || ' \"a'", normalize.translate_chars)
text_query("replace_dashes", _P, "p_name || '\u2013' || p_brand || '\u2014'", "p_name || '--' || p_brand || '---'", normalize.replace_map)
text_query("squeeze_repeats", _P, "p_name || repeat('!', p_size) || repeat('7', p_size)", "p_name || repeat('!', least(p_size, 3)) || repeat('7', p_size)", normalize.squeeze_repeats)
text_query("squeeze_count", _P, "repeat('!', p_size) || 'a' || repeat('?', p_size)", "CAST(CASE WHEN p_size > 3 THEN 2 ELSE 0 END AS INTEGER)", normalize.squeeze_count)
text_query("lowercase", _P, "upper(p_name)", "lower(p_name)", F.lower)
text_query("whiteout_links", _U, "'see ' || url || ' and bob@example.com now'", "'see  __uri__  and  __email__  now'", links.whiteout_links)
text_query("whiteout_leading_link", _U, "'http://example.com then'", "' then __uri__ '", links.whiteout_links)
text_query("find_links", _U, "'see http://' || " + _HOST.replace("'://", "'://") + " || '/a and more'", "'http://' || " + _HOST + " || '/a'", lambda c: F.array_join(F.transform(links.find_links(c), lambda x: x["string"]), " "))
text_query("link_struct", _U, "'see http://' || " + _HOST + " || '/a?b=1#c and more'", "'uri ' || " + _HOST + " || ' /a b=1 c'", lambda c: _joined(links.first_link(c), "entity_type", "host", "path", "query", "fragment"))
text_query("html_events", _P, "'<b class=\"x\">' || p_name || '</b>'", "'starttag:b data:' || p_name || ' endtag:b'", lambda c: F.array_join(F.transform(html.html_events(c), lambda e: F.concat_ws(":", e["event"], e["name"], e["data"])), " "))
text_query("sentence_split", _P, "'Mr. ' || p_brand || ' came. Next one is here.'", "'Mr. ' || p_brand || ' came. | Next one is here.'", lambda c: F.array_join(splitter.split_sentences(c, _MODEL), " | "))
text_query("sentence_spans", _P, "'It came. ' || p_brand || ' left.'", "'0:8 9:' || CAST(length(p_brand) + 15 AS VARCHAR(9))", lambda c: F.array_join(F.transform(splitter.sentence_spans(c, _MODEL), lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), " "))
text_query("sentence_debug", _P, "'Mr. ' || p_brand || ' came.'", "'mr. default decision false'", lambda c: _joined(F.get(splitter.sentence_decisions(c, _MODEL), F.lit(0)), "type1", "reason", "break_decision"))
text_query("sentence_tokenize", _P, "'Mr. Smith has 2 cats. She sees ' || " + _PICK("dogs", "men") + " || '.'", "'mr . smith have 2 cat . | she see ' || " + _PICK("dog", "man") + " || ' .'", lambda c: F.array_join(F.transform(pipelines.sentence_tokens(c, preset("reviews")["tokenizer"], _MODEL), lambda s: F.array_join(s, " ")), " | "))
text_query("tokenize_reviews", _P, "'<p>WOW &mdash; it is ' || " + _MOD(11) + " || ' out of 10!!!!!</p>'", "'wow --- it be <' || " + _MOD(11) + " || '/10> !!!'", lambda c: F.array_join(pipelines.word_tokens(c, preset("reviews")["tokenizer"]), " "))
text_query("tokenize_twitter", _P, "'RT @bob #' || " + _PICK("win", "fail") + " || ' http://t.co/x ' || " + _SIZE, "'rt <MENTION> <HASHTAG> #' || " + _PICK("win", "fail") + " || ' ' || " + _PICK("win", "fail") + " || ' <URI> <NUM> <NUM_' || CAST(length(" + _SIZE + ") AS VARCHAR(9)) || '>'", lambda c: F.array_join(pipelines.word_tokens(c, preset("twitter")["tokenizer"]), " "))
text_query("keras_words", _P, "'A, b;' || upper(p_brand) || '!'", "'a b ' || replace(lower(p_brand), '#', ' ')", lambda c: F.array_join(features.text_words(c), " "))
text_query("pad_pre", _P, "repeat('1,', p_size % 6 + 1)", "repeat('0 ', greatest(0, 3 - p_size % 6)) || trim(repeat('1 ', least(4, p_size % 6 + 1)))", lambda c: F.array_join(features.pad_sequence(F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int")), 4).cast("array<string>"), " "))
text_query("pad_post", _P, "repeat('1,', p_size % 6 + 1)", "trim(repeat('1 ', least(4, p_size % 6 + 1)) || repeat('0 ', greatest(0, 3 - p_size % 6)))", lambda c: F.array_join(features.pad_sequence(F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int")), 4, padding="post", truncating="post").cast("array<string>"), " "))

text_query("soup_html", _P, "'<p> ' || p_name || ' <b> x </b></p><br>' || p_brand", "p_name || 'x' || chr(10) || p_brand", lambda c: html.strip_html(c, "soup"))
text_query("broken_html", _P, "p_name || ' <![x ' || p_brand", "p_name || ' <![x ' || p_brand", html.strip_html)
text_query("link_fragments", _U, "'see http://' || " + _HOST + " || '/a, and more'", "'see |, and more'", lambda c: F.array_join(links.parse_links(c)["fragments"], "|"))
text_query("link_placeholders", _U, "'see http://' || " + _HOST + " || '/a or kim@example.org now'", "'see |<uri>| or |<email>| now'", lambda c: F.array_join(links.parse_links(c, placeholder="<%s>")["fragments"], "|"))
text_query("run_on_links", _U, "'http://example.org/http://' || " + _HOST + " || '/y?q=1'", "'http://example.org/ http://' || " + _HOST + " || '/y?q=1'", lambda c: F.array_join(F.transform(links.find_links(c), lambda x: x["string"]), " "))
text_query("sentence_realign", _P, "'(It came.) \"Then ' || p_brand || ' left!\" So be it.'", "'(It came.)|\"Then ' || p_brand || ' left!\"|So be it.'", lambda c: F.array_join(splitter.split_sentences(c, _MODEL), "|"))
text_query("sentence_lower_case", _P, "'He saw ' || p_brand || ' etc. but left. no more.'", "'He saw ' || p_brand || ' etc. but left.|no more.'", lambda c: F.array_join(splitter.split_sentences(c, _LOWER), "|"))
text_query("sentence_collocation", _P, "'See No. 5 of ' || p_brand || '. It is there.'", "'See No. 5 of ' || p_brand || '.|It is there.'", lambda c: F.array_join(splitter.split_sentences(c, _PAIRS), "|"))
text_query("sentence_initials", _P, "'By J. Bach of ' || p_brand || '. It is there.'", "'By J. Bach of ' || p_brand || '.|It is there.'", lambda c: F.array_join(splitter.split_sentences(c, splitter.Model(contexts={"bach": splitter.MIDDLE_UPPER})), "|"))
text_query("sentence_reasons", _P, "'He saw ' || p_brand || ' etc. The end came. no more.'", "'abbreviation + orthographic heuristic default decision'", lambda c: F.array_join(F.transform(splitter.sentence_decisions(c, _LOWER), lambda x: x["reason"]), " "))

_LOWER = splitter.Model(abbreviations=frozenset(["etc"]), contexts={"but": splitter.MIDDLE_LOWER, "the": splitter.MIDDLE_LOWER, "no": splitter.BEGIN_LOWER})
_PAIRS = splitter.Model(collocations=frozenset([("no", "##number##")]))
_MODEL = splitter.Model(abbreviations=frozenset(["mr", "dr"]))


def _joined(s, *fields: str):
    return F.concat_ws(" ", *(s[f].cast("string") for f in fields))


# Words and statistics of documents.
WORD = r"[\p{L}\p{M}\p{N}_]+"
_WORDS = "words AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '" + WORD + "')) AS term FROM documents)"
_POS = "words AS MATERIALIZED (SELECT doc, unnest(generate_series(0, len(w) - 1)) AS pos, unnest(w) AS term FROM (SELECT doc_id AS doc, regexp_extract_all(lower(text), '" + WORD + "') AS w FROM documents))"
_COUNTS = _WORDS + ", counts AS (SELECT doc, term, count(*) AS tf FROM words GROUP BY doc, term)"


def words_of(column: str) -> Column:
    return F.regexp_extract_all(F.lower(column), F.lit(WORD), F.lit(0))


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.token_table(table(spark, sf_dir, "documents"), "doc_id", words_of("text"))


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), words_of("text").alias("words"))


@query("SELECT doc_id AS id, text AS X, CAST(quality AS INTEGER) AS Y FROM documents JOIN labels USING (doc_id)")
def project_text(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return both.select(F.col("doc_id").alias("id"), F.col("text").alias("X"), F.col("quality").cast("int").alias("Y"))


@query("SELECT text AS X, CAST(quality AS INTEGER) AS Y FROM documents JOIN labels USING (doc_id) UNION ALL SELECT text, NULL FROM conversations")
def union_labeled_unlabeled(spark, sf_dir):
    from ..sources.tables import union_labeled

    labeled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    config = {"data": {"labeled": {"X": "text", "Y": "quality"}, "unlabeled": {"X": "text"}}}
    return union_labeled(labeled, table(spark, sf_dir, "conversations"), config)


@query("SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '7'), doc_id LIMIT 50")
def reservoir_sample(spark, sf_dir):
    return sampling.reservoir_sample(table(spark, sf_dir, "documents").select("doc_id"), 50, "doc_id", 7)


@query("SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '7'), doc_id) AS r FROM labels) WHERE r <= CASE quality WHEN 0 THEN 20 ELSE 40 END")
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(table(spark, sf_dir, "labels"), {0: 20, 1: 40}, "quality", "doc_id", 7).select("doc_id", "quality")


@query("SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '0'), 1, 7) AS BIGINT) % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM documents")
def train_test_split(spark, sf_dir):
    return sampling.train_test_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def drop_missing(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return sampling.drop_missing(both.select("doc_id", "quality"), "quality")


@query("SELECT doc_id, text FROM documents")
def json_lines_files(spark, sf_dir):
    """All documents as compressed JSON lines, and back by a pattern of file names; one field is read on its own."""
    path = folder(spark, "lines")
    tables.write_json_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return tables.read_json_lines(spark, f"{path}/part-*.json.gz", schema="doc_id bigint, text string")


@query("SELECT text FROM documents")
def json_lines_field(spark, sf_dir):
    path = folder(spark, "lines")
    tables.write_json_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), path, None)
    return tables.read_json_lines(spark, [path], field="text", schema="doc_id bigint, text string")


@query("SELECT doc_id AS id, text AS X, CAST(quality AS INTEGER) AS Y FROM documents JOIN labels USING (doc_id)")
def delimited_files(spark, sf_dir):
    """Labelled documents, line ends and quotes in them, as a delimited file with a header, and back by the fields' names."""
    path = folder(spark, "delimited")
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", "text")
    both.write.options(sep="\t", header=True, quoteAll=True, escape='"').csv(path)
    back = tables.read_delimited(spark, f"{path}/*.csv", sep="\t", header=True, escape='"', schema="doc_id bigint, quality int, text string")
    return back.select(F.col("doc_id").alias("id"), *(F.col(x).alias(y) for x, y in (("text", "X"), ("quality", "Y"))))


@query("SELECT 0 AS place, c_custkey AS id, c_name AS X, 1 AS Y FROM customer UNION ALL SELECT 1, s_suppkey, s_name, NULL FROM supplier")
def headerless_files(spark, sf_dir):
    """Files without a header, fields by their places, labelled and unlabelled rows as one."""
    one, two = folder(spark, "one"), folder(spark, "two")
    table(spark, sf_dir, "customer").select(F.lit(1).alias("y"), "c_name", "c_custkey").write.options(sep="\t").csv(one)
    table(spark, sf_dir, "supplier").select("s_name", "s_suppkey").write.options(sep="\t").csv(two)
    config = {"data": {"labeled": {"Y": 0, "X": 1}, "unlabeled": {"X": 0}}}
    read = [tables.read_delimited(spark, p, sep="\t") for p in (one, two)]
    ids = read[0].select(F.col("_c1").alias("X"), F.col("_c2").cast("long").alias("id"), F.lit(0).alias("place")).unionByName(read[1].select(F.col("_c0").alias("X"), F.col("_c1").cast("long").alias("id"), F.lit(1).alias("place")))
    return tables.union_labeled(*read, config).join(ids, "X").select("place", "id", "X", "Y")


@query("SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '0'), 1, 7) AS BIGINT) % 100 < 20 THEN 'test' ELSE 'train' END AS side FROM documents")
def split_files(spark, sf_dir):
    path = folder(spark, "split")
    tables.write_split(sampling.train_test_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id"), path)
    train, test = tables.read_split(spark, path)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def embedding_files(spark, sf_dir):
    path = folder(spark, "vectors")
    embeddings.save(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").alias("vector")), path)
    return embeddings.load(spark, path).select(F.col("word").alias("vec_id"), F.round(embeddings.norm("vector"), 6).alias("norm"))


@query(f"WITH {_WORDS} SELECT doc, count(*) AS n FROM words WHERE term NOT IN ('the', 'of', 'and') GROUP BY doc")
def stopword_filter(spark, sf_dir):
    return features.without_stop_words(document_tokens(spark, sf_dir), ["the", "of", "and"]).groupBy("doc").agg(F.count("*").alias("n"))


@query("SELECT page_id, md5(replace(regexp_replace(html, '(?s)<!--(.*?)-->[\\n]?', '\\1', 'g'), '<!--', '')) AS digest FROM pages")
def strip_comments(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(html.strip_comments("html")).alias("digest"))


def _without_tags(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '<(/?p|br)( [^>]*)?/?>', chr(10), 'g'), '<[^>]+>', '', 'g')"


# Pages hold one script, whose text is no markup; of references they hold those replaced here.
_PAGE_TEXT = "coalesce(" + _without_tags("x") + " || y || " + _without_tags("z") + ", '')"
_REPLACED = f"replace(replace(replace(replace({_PAGE_TEXT}, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '\"'), '&amp;', '&')"


@query(f"""WITH a AS (SELECT page_id, replace(regexp_replace(html, '(?s)<!--(.*?)-->[\\n]?', '\\1', 'g'), '<!--', '') AS h FROM pages),
b AS (SELECT page_id, h, regexp_extract(h, '(?s)^(.*?<script>)(.*?)(</script>.*)$', ['x', 'y', 'z']) AS s FROM a),
c AS (SELECT page_id, CASE WHEN s.x = '' THEN h ELSE s.x END AS x, s.y AS y, s.z AS z FROM b)
SELECT page_id, trim({_REPLACED}, chr(10) || ' ') AS text FROM c""")
def strip_html_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.strip_html("html").alias("text"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+(?:[-+.''][A-Za-z0-9_]+)*@(?:[a-z0-9-]+[.])+(?:com|org|net)')) AS emails,
len(regexp_extract_all(text, '\\b(?:[0-9]{1,3}[.]){3}[0-9]{1,3}\\b')) AS uris FROM documents WHERE text IS NOT NULL""")
def emails_in_docs(spark, sf_dir):
    """E-mail addresses, and links to addresses by number, of every whole document. A full stop without its space may
    look like a host ("end.do"): a link to find_links(), but none of these."""
    found = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", links.find_links("text").alias("links"))
    of = lambda k: F.size(F.filter("links", k)).cast("long")
    emails, uris = of(lambda x: x["entity_type"] == "email"), of(lambda x: (x["entity_type"] == "uri") & x["ip_addr"].isNotNull())
    return found.select("doc_id", emails.alias("emails"), uris.alias("uris"))


@query(f"WITH {_WORDS} SELECT term, count(*) AS n FROM words GROUP BY term")
def word_freq(spark, sf_dir):
    return features.word_frequencies(document_tokens(spark, sf_dir))


@query(f"WITH {_COUNTS} SELECT term, count(*) AS df FROM counts GROUP BY term")
def doc_freq(spark, sf_dir):
    return features.document_frequencies(features.term_counts(document_tokens(spark, sf_dir)))


@query(f"WITH {_COUNTS} SELECT doc, term, tf FROM counts")
def bow_counts(spark, sf_dir):
    return features.term_counts(document_tokens(spark, sf_dir))


@query(f"WITH {_COUNTS}, idf AS (SELECT term, ln((1.0 + (SELECT count(DISTINCT doc) FROM counts)) / (1 + count(*))) + 1 AS idf FROM counts GROUP BY term), raw AS (SELECT doc, term, tf * idf AS w FROM counts JOIN idf USING (term)) SELECT doc, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 6) AS tfidf FROM raw")
def tfidf(spark, sf_dir):
    return features.tfidf(features.term_counts(document_tokens(spark, sf_dir))).select("doc", "term", F.round("tfidf", 6).alias("tfidf"))


_FIT = "fit AS (SELECT * FROM counts WHERE CAST('0x' || substr(md5(CAST(doc AS VARCHAR) || '0'), 1, 7) AS BIGINT) % 100 >= 20)"


@query(f"WITH {_COUNTS}, {_FIT}, idf AS (SELECT term, ln((1.0 + (SELECT count(DISTINCT doc) FROM fit)) / (1 + count(*))) + 1 AS idf FROM fit GROUP BY term), raw AS (SELECT doc, term, tf * idf AS w FROM counts JOIN idf USING (term)) SELECT doc, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 6) AS tfidf FROM raw")
def tfidf_fitted(spark, sf_dir):
    """All documents by the document frequencies of those on the training side."""
    counts = features.term_counts(document_tokens(spark, sf_dir))
    fit = sampling.train_test_split(counts, "doc").where("split = 'train'").drop("split")
    return features.tfidf(counts, fit).select("doc", "term", F.round("tfidf", 6).alias("tfidf"))


@query(f"WITH {_COUNTS}, often AS (SELECT term FROM counts GROUP BY term HAVING count(*) >= 5) SELECT doc, (SELECT count(*) FROM often) + 64 AS size, count(*) + 64 AS held FROM counts JOIN often USING (term) JOIN embeddings ON vec_id = doc GROUP BY doc")
def feature_union(spark, sf_dir):
    """TF-IDF and an embedding side by side, as a classifier gets them."""
    from pyspark.ml import Pipeline

    docs = _lists(spark, sf_dir).withColumnRenamed("words", "tokens")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), "embedding")
    both = docs.join(vectors, "doc", "left")
    fitted = Pipeline(stages=classify.feature_stages(("bow", "embedding"), min_df=5.0)).fit(both.withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0), 64).cast("array<float>"))))
    held = F.udf(lambda v: (int(v.size), int(v.numNonzeros())), "size bigint, held bigint")  # a vector stays sparse
    out = fitted.transform(both.where("embedding is not null")).select("doc", held("features").alias("v"))
    return out.select("doc", "v.size", "v.held").where("held > 64")


@query(f"WITH {_WORDS} SELECT term, row_number() OVER (ORDER BY term) - 1 AS id FROM (SELECT DISTINCT term FROM words)")
def term_dictionary(spark, sf_dir):
    return features.term_dictionary(document_tokens(spark, sf_dir))


@query(f"WITH {_WORDS} SELECT DISTINCT doc, term, CAST(1 AS INTEGER) AS value FROM words")
def binary_bag(spark, sf_dir):
    return features.binary_bag(document_tokens(spark, sf_dir))


@query(f"WITH {_POS}, v AS (SELECT term, row_number() OVER (ORDER BY d, p) - 1 AS id FROM (SELECT term, min(doc) AS d, arg_min(pos, (doc, pos)) AS p FROM words GROUP BY term)) SELECT doc, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM words JOIN v USING (term) GROUP BY doc")
def vocab_encode(spark, sf_dir):
    codes = features.coded(_lists(spark, sf_dir))
    return features.decoded(codes, features.first_seen_vocabulary(codes)).select("doc", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


_SENTENCES = "SELECT doc_id AS doc, regexp_extract_all(lower(text), '[^.!?]+') AS s FROM documents"


def _sentence_docs(spark, sf_dir):
    raw = F.regexp_extract_all(F.lower("text"), F.lit("[^.!?]+"), F.lit(0))
    words = F.transform(raw, lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("s"))


@query(f"SELECT doc, i - 1 AS s, array_to_string(regexp_extract_all(s[i], '" + WORD + f"'), ' ') AS words FROM (SELECT doc, s, unnest(generate_series(1, len(s))) AS i FROM ({_SENTENCES}))")
def sentence_stream(spark, sf_dir):
    """Each sentence of each document, as the learners of word vectors read them."""
    out = features.sentence_labels(_sentence_docs(spark, sf_dir), "doc_id", "s", ())
    return out.select("doc", F.col("s").cast("long").alias("s"), F.array_join("words", " ").alias("words"))


@query("SELECT doc, array_to_string(flatten(list_transform(s, lambda x: regexp_extract_all(x, '" + WORD + f"'))), ' ') AS words FROM ({_SENTENCES})")
def flatten_sentences(spark, sf_dir):
    return _sentence_docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.array_join(features.flatten_sentences("s"), " ").alias("words"))


@query(f"SELECT doc, i - 1 AS s, 'SENT_' || doc || '_' || (i - 1) || ' DOC_' || doc AS labels FROM (SELECT doc, unnest(generate_series(1, len(s))) AS i FROM ({_SENTENCES}))")
def sentence_labels(spark, sf_dir):
    out = features.sentence_labels(_sentence_docs(spark, sf_dir), "doc_id", "s")
    return out.select("doc", F.col("s").cast("long").alias("s"), F.array_join("labels", " ").alias("labels"))


@query(f"WITH {_COUNTS} SELECT doc, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS words, round(max(e.embedding[1]::DOUBLE), 6) AS first FROM counts JOIN embeddings e ON e.vec_id = doc GROUP BY doc")
def mixed_features(spark, sf_dir):
    counts = features.term_counts(document_tokens(spark, sf_dir)).groupBy("doc").agg(F.count("*").alias("terms"), F.sum("tf").alias("words"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), "embedding")
    both = sampling.drop_missing(counts.join(vectors, "doc"), "embedding")
    return both.select("doc", "terms", "words", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


_E = "e AS (SELECT vec_id, label, d - 1 AS d, embedding[d]::DOUBLE AS x FROM embeddings, unnest(generate_series(1, 64)) AS u(d))"


@query(f"WITH {_E} SELECT label, d, round(avg(x), 6) AS x FROM e GROUP BY label, d")
def mean_vector(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    tokens = rows.select("label", F.col("vec_id").cast("string").alias("term"))
    vectors = rows.select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vector"))
    out = embeddings.mean_vectors(tokens, vectors, ["label"]).select("label", F.posexplode("vector").alias("d", "x"))
    return out.select("label", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))


@query(f"WITH {_E}, s AS (SELECT label AS doc, vec_id % 3 AS sentence, d, avg(x) AS x FROM e GROUP BY ALL) SELECT doc, d, round(avg(x), 6) AS x FROM s GROUP BY doc, d")
def doc_vector(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    tokens = rows.select(F.col("label").alias("doc"), (F.col("vec_id") % 3).alias("sentence"), F.col("vec_id").cast("string").alias("term"))
    vectors = rows.select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vector"))
    out = embeddings.document_vectors(tokens, vectors).select("doc", F.posexplode("vector").alias("d", "x"))
    return out.select("doc", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))


@query(f"WITH {_E} SELECT vec_id, round(sqrt(sum(x * x)), 6) AS norm FROM e GROUP BY vec_id")
def vector_norm(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(embeddings.norm("embedding"), 6).alias("norm"))


@query("WITH p AS (SELECT q.vec_id AS query, v.vec_id AS found, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS c FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, found) AS rank FROM p) SELECT query, CAST(rank AS INTEGER) AS rank, found, round(c, 6) AS cosine FROM r WHERE rank <= 10")
def nearest_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    out = embeddings.nearest(rows, rows.where("vec_id % 50 = 0"), 10, "vec_id", "embedding")
    return out.select("query", "rank", "found", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {_POS} SELECT least(a.term, b.term) AS term, greatest(a.term, b.term) AS other, round(sum(1.0 / k), 6) AS weight FROM words a CROSS JOIN range(1, 6) t(k) JOIN words b ON a.doc = b.doc AND b.pos = a.pos + k GROUP BY ALL")
def cooccurrence(spark, sf_dir):
    return features.cooccurrences(document_words(spark, sf_dir), 5).select("term", "other", F.round("weight", 6).alias("weight"))


def _lists(spark, sf_dir):
    return document_words(spark, sf_dir).where(F.size("words") > 0)


def _vectors(vectors: DataFrame, size: int, unit: bool = True) -> DataFrame:
    """word, and whether its vector is what it should be: of that size, finite, and of unit length."""
    fits = (F.size("vector") == size) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("word", (fits & (F.abs(embeddings.norm("vector") - 1) < 1e-6) if unit else fits).alias("fits"))


@query(f"WITH {_POS} SELECT term AS word, true AS fits FROM words GROUP BY term HAVING count(*) >= 5")
def word2vec_vocab(spark, sf_dir):
    return _vectors(embeddings.word2vec(_lists(spark, sf_dir), size=16, min_count=5, window=5), 16)


@query()
def word2vec_synonyms(spark, sf_dir):
    vectors = embeddings.word2vec(_lists(spark, sf_dir), size=16, min_count=5, window=5)
    return embeddings.nearest(vectors, vectors.orderBy("word").limit(18))  # a report on 18 words


@query(f"WITH {_POS} SELECT 'DOC_' || doc AS word, true AS fits FROM words GROUP BY doc")
def doc2vec_tags(spark, sf_dir):
    docs = _lists(spark, sf_dir).select("doc", F.array("words").alias("s"))
    labels = features.sentence_labels(docs, "doc", "s", ("document",))
    return _vectors(embeddings.doc2vec(labels, size=16, min_count=1, window=5).where(F.col("word").startswith("DOC_")), 16)


@query(f"WITH {_POS} SELECT term AS word, true AS fits FROM words GROUP BY term")
def glove_vectors(spark, sf_dir):
    return _vectors(embeddings.glove(document_words(spark, sf_dir), size=16, epochs=2, window=5), 16, unit=False)


_INDEX = _POS + ", ix AS (SELECT term, count(*) AS n, count(DISTINCT doc) AS docs, row_number() OVER (ORDER BY count(*) DESC, term) AS id FROM words GROUP BY term)"
_SEQ = _INDEX + ", sq AS (SELECT doc, pos, id FROM words JOIN ix USING (term)), cells AS (SELECT doc, id, count(*) AS c, any_value(len) AS len FROM (SELECT *, count(*) OVER (PARTITION BY doc) AS len FROM sq) WHERE id < (SELECT count(*) FROM ix) GROUP BY doc, id)"


@query(f"WITH {_INDEX} SELECT term, n, docs, id FROM ix")
def keras_word_index(spark, sf_dir):
    return features.word_index(features.coded(_lists(spark, sf_dir)))


def _seqs(spark, sf_dir):
    codes = features.coded(_lists(spark, sf_dir))
    return features.sequences(codes, features.word_index(codes))


@query(f"WITH {_INDEX} SELECT doc, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM words JOIN ix USING (term) WHERE id < 100 GROUP BY doc")
def keras_sequences(spark, sf_dir):
    codes = features.coded(_lists(spark, sf_dir))
    return features.sequences(codes, features.word_index(codes), 100).select("doc", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


def _matrix_query(mode: str, value: str) -> None:
    @query(f"WITH {_SEQ} SELECT doc, id, round({value}, 6) AS value FROM cells" + (" JOIN (SELECT id, docs FROM ix) USING (id)" if mode == "tfidf" else ""), f"keras_{mode}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        codes = features.coded(_lists(spark, sf_dir))
        index = stored(features.word_index(codes))
        seqs = features.sequences(codes, index)
        out = features.sequence_matrix(seqs, mode, index.count(), index.select("id", "docs"), codes.where("codes is not null").count())
        return out.select("doc", "id", F.round("value", 6).alias("value"))


_matrix_query("binary", "1.0::DOUBLE")
_matrix_query("count", "c::DOUBLE")
_matrix_query("freq", "c::DOUBLE / len")
_matrix_query("tfidf", "ln(c::DOUBLE / len) / (1 + ln(1 + docs::DOUBLE / ((SELECT count(DISTINCT doc) FROM words) + 1)))")


@query(f"WITH {_POS} SELECT doc, string_agg(CAST(CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 999 + 1 AS VARCHAR), ' ' ORDER BY pos) AS ids FROM words GROUP BY doc")
def keras_onehot(spark, sf_dir):
    ids = features.hashed_ids("words", 1000, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"))
    return _lists(spark, sf_dir).select("doc", F.array_join(ids.cast("array<string>"), " ").alias("ids"))


@query("SELECT r AS rank, round(least(1.0, sqrt(1e-5 * (greatest(r, 1) * (ln(greatest(r, 1)) + 0.577) + 0.5 - 1.0 / (12.0 * greatest(r, 1))))), 6) AS p FROM range(1000) t(r)")
def sampling_table(spark, sf_dir):
    return features.sampling_table(spark, 1000).select("rank", F.round("p", 6).alias("p"))


@query(f"WITH {_INDEX}, sq AS (SELECT doc, pos, id FROM words JOIN ix USING (term)) SELECT a.doc, a.id AS word, b.id AS context, CAST(1 AS INTEGER) AS label FROM sq a CROSS JOIN (VALUES (-4), (-3), (-2), (-1), (1), (2), (3), (4)) t(k) JOIN sq b ON a.doc = b.doc AND b.pos = a.pos + k")
def skipgrams_pos(spark, sf_dir):
    return features.skipgram_pairs(_seqs(spark, sf_dir))


@query(f"WITH {_INDEX}, sq AS (SELECT doc, pos, id FROM words JOIN ix USING (term)) SELECT a.doc, a.id AS word, count(*) AS n, 0 AS label, true AS known FROM sq a CROSS JOIN (VALUES (-4), (-3), (-2), (-1), (1), (2), (3), (4)) t(k) JOIN sq b ON a.doc = b.doc AND b.pos = a.pos + k GROUP BY a.doc, a.id")
def skipgrams_neg(spark, sf_dir):
    """Of each document's words: as many negatives as positives, their contexts among the known ids."""
    out = features.skipgram_negatives(features.skipgram_pairs(_seqs(spark, sf_dir)), 1000)
    return out.groupBy("doc", "word").agg(F.count("*").alias("n"), F.max("label").alias("label"), F.min(F.col("context").between(1, 999)).alias("known"))


text_query("lemmatize", _P, _PICK("cries", "is", "making", "stopped", "watches", "went", "tries"), _PICK("cry", "be", "make", "stop", "watch", "go", "try"), lambda c: morphology.lemma_column(c, "v"))
text_query("porter_stem", _P, _PICK("caresses", "ponies", "relational", "hopping", "motoring", "sky", "electrical"), _PICK("caress", "poni", "relat", "hop", "motor", "sky", "electr"), morphology.stem_column)
text_query("pos_map", _P, _PICK("JJ", "VBZ", "NN", "RB", "NNS", "JJR"), _PICK("a", "v", "n", "r", "n", "a"), morphology.class_of_tag)


@query(f"WITH {_POS} SELECT doc, string_agg(term, ' ' ORDER BY pos) AS words FROM words GROUP BY doc")
def json_roundtrip(spark, sf_dir):
    """Token arrays as JSON lines and back."""
    lines = _lists(spark, sf_dir).select(F.to_json(F.struct("doc", "words")).alias("line"))
    back = lines.select(F.from_json("line", "doc bigint, words array<string>").alias("r")).select("r.*")
    return back.select("doc", F.array_join("words", " ").alias("words"))


@query(f"WITH {_POS} SELECT doc, CAST(count(*) FILTER (WHERE term = 'the') AS INTEGER) AS the, CAST(count(*) FILTER (WHERE term LIKE 'th%') AS INTEGER) AS th FROM words GROUP BY doc")
def token_counts(spark, sf_dir):
    return _lists(spark, sf_dir).select("doc", features.count_token("words", "the").alias("the"), features.count_prefix("words", "th").alias("th"))


@query("SELECT item_id FROM benchmark ORDER BY item_id LIMIT 25")
def limit_rows(spark, sf_dir):
    from ..sources.tables import limit_rows as first_rows

    return first_rows(table(spark, sf_dir, "benchmark").select("item_id"), 25, "item_id")


@query(f"WITH {_INDEX}, sq AS (SELECT doc, pos, id FROM words JOIN ix USING (term)) SELECT id, count(DISTINCT doc) AS docs FROM sq GROUP BY id")
def keras_id_documents(spark, sf_dir):
    return features.id_documents(_seqs(spark, sf_dir))


@query("SELECT doc_id, CAST(1 - quality AS INTEGER) AS zero, CAST(quality AS INTEGER) AS one FROM labels")
def one_hot_label(spark, sf_dir):
    label = features.one_hot_label(F.col("quality"))
    return table(spark, sf_dir, "labels").select("doc_id", F.get(label, F.lit(0)).alias("zero"), F.get(label, F.lit(1)).alias("one"))


@query(f"WITH {_COUNTS} SELECT term, df FROM (SELECT term, count(*) AS df FROM counts GROUP BY term) WHERE df >= 5")
def frequent_terms(spark, sf_dir):
    return sentences.keep_frequent(features.document_frequencies(features.term_counts(document_tokens(spark, sf_dir))), 5, "df")


@query("SELECT doc_id, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '3'), 1, 7) AS BIGINT) % 100 % 5 AS INTEGER) AS fold FROM labels")
def cv_folds(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", classify.fold("doc_id", 5, 3).alias("fold"))


# Sentence model statistics over white-space tokens.
_TOK = "tok AS (SELECT doc, i - 1 AS pos, w[i] AS tok FROM (SELECT doc_id AS doc, regexp_extract_all(text, '[^ \\t\\n]+') AS w FROM documents) t, unnest(generate_series(1, len(w))) AS u(i)), ty AS MATERIALIZED (SELECT *, CASE WHEN regexp_matches(tok, '^-?[.,]?[0-9][0-9,.-]*[.]?$') THEN '##number##' ELSE lower(tok) END AS type FROM tok)"


def _plain_words(spark, sf_dir):
    return sentences.words_of_lists(table(spark, sf_dir, "documents"), "doc_id", F.regexp_extract_all("text", F.lit("[^ \\t\\n]+"), F.lit(0)))


@query(f"WITH {_TOK} SELECT type, count(*) AS n FROM ty GROUP BY type")
def punkt_type_freq(spark, sf_dir):
    return sentences.type_counts(_plain_words(spark, sf_dir))


@query(f"WITH {_TOK} SELECT count(*) AS n, CAST(sum(CASE WHEN tok LIKE '%.' THEN 1 ELSE 0 END) AS BIGINT) AS periods FROM ty")
def punkt_totals(spark, sf_dir):
    return sentences.totals_of(_plain_words(spark, sf_dir))


_SCORE = """f AS (SELECT type, count(*)::DOUBLE AS n FROM ty GROUP BY type), tot AS (SELECT count(*)::DOUBLE AS total, sum(CASE WHEN tok LIKE '%.' THEN 1.0 ELSE 0 END) AS periods FROM ty),
c AS (SELECT a.type[1:-2] AS type, a.n AS wn, coalesce(b.n, 0) AS on_ FROM f a LEFT JOIN f b ON b.type = a.type[1:-2] WHERE a.type LIKE '%.' AND length(a.type) > 1 AND regexp_matches(a.type, '[\\p{L}_]') AND a.type <> '##number##'),
s AS (SELECT type, wn, on_, length(type) - length(replace(type, '.', '')) + 1 AS dots, length(type) - (length(type) - length(replace(type, '.', ''))) AS letters FROM c)"""


_ABBREVIATIONS = "SELECT type, -2.0 * ((wn * ln(periods / total) + on_ * ln(1.0 - periods / total)) - (wn * ln(0.99::DOUBLE) + on_ * ln(1.0 - 0.99::DOUBLE))) * exp(-letters) * dots * pow(letters, -on_) AS score FROM s, tot"


@query(f"WITH {_TOK}, {_SCORE} SELECT type, round(score, 6) + 0.0 AS score FROM ({_ABBREVIATIONS})")
def punkt_abbrevs(spark, sf_dir):
    words = _plain_words(spark, sf_dir)
    out = sentences.abbreviation_scores(sentences.type_counts(words), sentences.totals_of(words))
    return out.select("type", (F.round("score", 6) + 0.0).alias("score"))


@query()
def punkt_words(spark, sf_dir):
    return sentences.word_table(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("tok").agg(F.count("*").alias("n"))


def _learned(spark, sf_dir):
    return sentences.learn(_plain_words(spark, sf_dir), keep=False)


def _ln(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN ln({x}) END)"


def _ratio(a: str, b: str, ab: str) -> str:
    """The likelihood ratio of a pair in SQL: counts of both and of the pair."""
    total, p1, p2 = "total", f"({ab} / {a})", f"(({b} - {ab}) / nullif(total - {a}, 0))"
    p = f"({b} / {total})"
    rest = f"({total} - {a} - {b} + {ab})"
    one, two = f"{ab} * {_ln(p)} + ({a} - {ab}) * {_ln('1 - ' + p)}", f"({b} - {ab}) * {_ln(p)} + {rest} * {_ln('1 - ' + p)}"
    three = f"CASE WHEN {a} = {ab} THEN 0 ELSE {ab} * {_ln(p1)} + ({a} - {ab}) * {_ln('1 - ' + p1)} END"
    four = f"CASE WHEN {b} = {ab} THEN 0 ELSE ({b} - {ab}) * {_ln(p2)} + {rest} * {_ln('1 - ' + p2)} END"
    return f"-2.0 * ({one} + {two} - {three} - {four})"


_LETTER = "[\\p{L}\\p{M}\\p{Nl}\\p{Pc}]"
_MARKED = f"""{_TOK}, {_SCORE}, ab AS MATERIALIZED (SELECT DISTINCT type FROM ({_ABBREVIATIONS}) WHERE score >= 0.3),
w AS (SELECT doc, pos, tok, type, ends_with(tok, '.') AS pf, type = '##number##' AS num, regexp_full_match(tok, '{_LETTER}\\.') AS ini, regexp_full_match(tok, '{_LETTER}+') AS alpha, regexp_matches(type, '{_LETTER}') AS np,
      CASE WHEN regexp_matches(tok, '^\\p{{Ll}}') THEN 'lower' WHEN regexp_matches(tok, '^\\p{{Lu}}') THEN 'upper' ELSE 'none' END AS cs, ends_with(tok, '.') AND NOT ends_with(tok, '..') AND tok <> '.' AS single, lower(tok[1:-2]) AS stem FROM ty),
v AS (SELECT *, single AND (stem IN (SELECT type FROM ab) OR string_split(stem, '-')[-1] IN (SELECT type FROM ab)) AS abbr FROM w),
u AS (SELECT *, tok IN ('.', '?', '!') OR (single AND NOT abbr) AS brk, regexp_full_match(tok, '\\.\\.+') AS ell, CASE WHEN length(type) > 1 AND ends_with(type, '.') THEN type[1:-2] ELSE type END AS bare FROM v),
k AS (SELECT *, CASE WHEN brk THEN bare ELSE type END AS key FROM u),
x AS MATERIALIZED (SELECT *, lead(tok) OVER d AS next_tok, lead(type) OVER d AS next_type, lead(key) OVER d AS next_key, lead(cs) OVER d AS next_case, lead(alpha) OVER d AS next_alpha, lead(np) OVER d AS next_np,
      lag(brk) OVER d AS p_brk, lag(abbr) OVER d AS p_abbr, lag(ell) OVER d AS p_ell, lag(num) OVER d AS p_num, lag(ini) OVER d AS p_ini FROM k WINDOW d AS (PARTITION BY doc ORDER BY pos)),
both_n AS MATERIALIZED (SELECT t, sum(n)::DOUBLE AS n FROM (SELECT type AS t, n FROM f UNION ALL SELECT type[1:-2], n FROM f WHERE ends_with(type, '.')) GROUP BY t),
places AS (SELECT key, cs, CASE WHEN coalesce(p_brk, true) AND NOT coalesce(p_num OR p_ini, false) THEN 'initial' WHEN coalesce(p_brk, true) OR coalesce(p_ell OR p_abbr, false) THEN 'unknown' ELSE 'internal' END AS place FROM x),
ortho AS MATERIALIZED (SELECT key AS type, CAST(bit_or(CASE cs WHEN 'upper' THEN CASE place WHEN 'initial' THEN 2 WHEN 'internal' THEN 4 ELSE 8 END ELSE CASE place WHEN 'initial' THEN 16 WHEN 'internal' THEN 32 ELSE 64 END END) AS INTEGER) AS bits FROM places WHERE cs <> 'none' GROUP BY key),
st AS (SELECT next_type AS type, count(*)::DOUBLE AS n FROM x WHERE pf AND brk AND NOT num AND NOT ini AND next_alpha GROUP BY next_type),
st2 AS (SELECT st.type, st.n, b.n AS all_n, (SELECT count(*) FILTER (WHERE brk) FROM x)::DOUBLE AS breaks, total FROM st JOIN both_n b ON b.t = st.type, tot),
starters AS MATERIALIZED (SELECT type, score FROM (SELECT *, {_ratio("breaks", "all_n", "n")} AS score FROM st2 WHERE all_n >= n) WHERE score >= 30 AND total / breaks > all_n / n)"""


@query(f"WITH {_MARKED} SELECT type, round(score, 3) AS score FROM starters")
def punkt_starters(spark, sf_dir):
    return _learned(spark, sf_dir).starters.select("type", F.round("score", 3).alias("score"))


@query(f"""WITH {_MARKED}, pairs AS (SELECT bare AS type1, next_key AS type2, count(*)::DOUBLE AS n FROM x WHERE pf AND next_tok IS NOT NULL AND np AND next_np GROUP BY ALL),
cc AS (SELECT type1, type2, p.n, a.n AS n1, b.n AS n2, total FROM pairs p JOIN both_n a ON a.t = type1 JOIN both_n b ON b.t = type2, tot WHERE type2 NOT IN (SELECT type FROM starters))
SELECT type1, type2, round(score, 3) AS score FROM (SELECT *, {_ratio("n1", "n2", "n")} AS score FROM cc WHERE n1 > 1 AND n2 > 1 AND n > 2 AND n <= least(n1, n2)) WHERE score >= 7.88 AND total / n1 > n2 / n""")
def punkt_collocations(spark, sf_dir):
    return _learned(spark, sf_dir).collocations.select("type1", "type2", F.round("score", 3).alias("score"))


@query(f"WITH {_MARKED} SELECT type, bits FROM ortho")
def punkt_ortho(spark, sf_dir):
    return _learned(spark, sf_dir).contexts


@query(f"""WITH {_MARKED}, r AS (SELECT key AS type, bare AS found, next_tok, next_case, bits FROM x LEFT JOIN ortho ON ortho.type = next_key WHERE pf AND next_tok IS NOT NULL AND brk AND NOT abbr AND key NOT IN (SELECT type FROM ab)),
seldom AS (SELECT r.* FROM r LEFT JOIN f a ON a.type = r.type LEFT JOIN f b ON b.type = r.type[1:-2] WHERE coalesce(a.n, 0) + coalesce(b.n, 0) < 5)
SELECT type FROM ab UNION SELECT found FROM seldom WHERE next_tok[1] IN (',', ':', ';') OR (next_case = 'lower' AND bits & 2 <> 0 AND bits & 4 = 0)""")
def punkt_abbreviations(spark, sf_dir):
    """Frequent and rare abbreviations of the learned model."""
    return _learned(spark, sf_dir).abbreviations


@query(f"WITH {_MARKED} SELECT type, bits FROM ortho")
def punkt_files(spark, sf_dir):
    """A learned model, saved and read again."""
    path = folder(spark, "model")
    _learned(spark, sf_dir).save(path)
    return sentences.load(spark, path).contexts


@query(f"WITH {_TOK} SELECT type, count(*) AS n FROM ty GROUP BY type HAVING count(*) >= 3")
def punkt_merged(spark, sf_dir):
    """Counts of two halves of the corpus, added up and pruned."""
    words = _plain_words(spark, sf_dir)
    side = F.pmod(F.xxhash64("doc"), F.lit(2))
    halves = [sentences.type_counts(words.where(side == i)) for i in (0, 1)]
    return sentences.keep_frequent(sentences.merged_counts(*halves), 3)


# Evaluation.
_SCORED = "scored AS (SELECT doc_id, quality AS label, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 7) AS BIGINT) % 1000 / 1000.0::DOUBLE AS score FROM labels)"


def _scored(spark, sf_dir):
    place = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 7), 16, 10).cast("long") % 1000
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), (place / 1000.0).alias("score"))


@query(f"""WITH {_SCORED}, p AS (SELECT label::DOUBLE AS y, CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS p FROM scored),
r AS (SELECT y AS label, sum(CASE WHEN y = p THEN 1 ELSE 0 END)::DOUBLE / (SELECT count(*) FROM p q WHERE q.p = t.y) AS precision, sum(CASE WHEN y = p THEN 1 ELSE 0 END)::DOUBLE / count(*) AS recall, count(*) AS support FROM p t GROUP BY y),
f AS (SELECT label, precision, recall, 2 * precision * recall / (precision + recall) AS f1, support FROM r)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT NULL, round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def classification_report(spark, sf_dir):
    out = classify.classification_report(_scored(spark, sf_dir).withColumn("prediction", (F.col("score") >= 0.5).cast("double")))
    return out.select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


_CURVE = _SCORED + ", c AS (SELECT score AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score), curve AS (SELECT threshold, sum(neg) OVER w::DOUBLE / (SELECT sum(neg) FROM c) AS fpr, sum(pos) OVER w::DOUBLE / (SELECT sum(pos) FROM c) AS tpr FROM c WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"
_CURVE = _CURVE.replace("sum(neg) OVER w::DOUBLE", "(sum(neg) OVER w)::DOUBLE").replace("sum(pos) OVER w::DOUBLE", "(sum(pos) OVER w)::DOUBLE")


@query(f"WITH {_CURVE} SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM curve")
def roc_curve(spark, sf_dir):
    return classify.roc_curve(_scored(spark, sf_dir)).select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(f"WITH {_CURVE} SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auc FROM (SELECT *, coalesce(lag(fpr) OVER (ORDER BY threshold DESC), 0) AS f0, coalesce(lag(tpr) OVER (ORDER BY threshold DESC), 0) AS t0 FROM curve)")
def roc_auc(spark, sf_dir):
    return classify.roc_auc(classify.roc_curve(_scored(spark, sf_dir))).select(F.round("auc", 6).alias("auc"))


def _training(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select("doc_id", F.col("quality").cast("double").alias("label"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("tokens"))


def _grid_query(name: str, values: dict | None) -> None:
    @query(name=f"grid_search_{name}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = classify.search(_training(spark, sf_dir), name, features=classify.feature_stages(("bow",), min_df=5.0), folds=2, values=values)
        return classify.search_report(model)


_grid_query("lr", {"regParam": [0.1, 1.0], "elasticNetParam": [0.0]})
_grid_query("svm", {"regParam": [0.1, 1.0], "maxIter": [10]})
_grid_query("random_forest", None)  # the whole grid
_grid_query("boost", {"maxIter": [3], "maxDepth": [2]})


@query()
def feature_importance(spark, sf_dir):
    from pyspark.ml import Pipeline

    rows = _training(spark, sf_dir)
    pipe = Pipeline(stages=classify.feature_stages(("bow",), min_df=5.0)).fit(rows)
    names = next(s.vocabulary for s in pipe.stages if hasattr(s, "vocabulary"))
    return classify.feature_importance(pipe.transform(rows), names, trees=10)


@query(f"WITH {_WORDS}, l AS (SELECT quality, term FROM words JOIN labels ON doc_id = doc) SELECT quality, term, n FROM (SELECT quality, term, count(*) AS n, row_number() OVER (PARTITION BY quality ORDER BY count(*) DESC, term) AS r FROM l GROUP BY quality, term) WHERE r <= 25")
def top_terms(spark, sf_dir):
    """The flagship: the most frequent terms of each label."""
    from pyspark.sql import Window

    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc"), "quality")
    counts = document_tokens(spark, sf_dir).join(labels, "doc").groupBy("quality", "term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("quality").orderBy(F.desc("n"), "term")
    return counts.withColumn("r", F.row_number().over(order)).where("r <= 25").drop("r")
