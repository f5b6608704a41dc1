"""Learning a sentence model from a corpus with distributed counts.

A corpus is a table of words (see word_table). Each step is an aggregation or a window within a document: counts of
types, likelihood ratios for abbreviations, contexts of cases by the word before, rare abbreviations, sentence
starters, collocations. A document starts as a paragraph after a sentence's end, so that documents need no order.
Counts of several corpora can be added up (statistics are mergeable) before they are judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import splitter as S
from .durable import stored

# Thresholds of the method.
ABBREVIATION = 0.3
RARE_BELOW = 5
COLLOCATION = 7.88
STARTER = 30.0
MIN_COLLOCATION = 2
#: Words that a task hands on at a time.
WORDS_AT_A_TIME = 200_000
#: Abbreviations that are broadcast to find them among words; more are joined as Spark sees fit.
BROADCAST_TYPES = 200_000
#: What the steps of learning read of adjoining words.
ANNOTATIONS = ("tok", "n", "parastart", "linestart", "type", "key", "case", "is_alpha", "is_non_punct", "sentbreak", *(f"prev_{c}" for c in ("key", "bare", "period_final", "sentbreak", "abbr", "ellipsis", "is_number", "is_initial", "is_non_punct")))
#: Entries that a model may have on the driver and the workers.
MAX_TYPES = 2_000_000


def word_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per word: doc, pos and the word's own properties. Python splits the texts, the rest is native."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc", "pos", "tok", "parastart", "linestart", "prev_tok"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toks, owner, pos, para, line, prev = [], [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                at, last = 0, None
                for paragraph, own in S.lines_of_words(text or ""):
                    toks += own
                    owner += [i] * len(own)
                    pos += range(at, at + len(own))
                    para += [paragraph] + [False] * (len(own) - 1) if own else []
                    line += [True] + [False] * (len(own) - 1) if own else []
                    prev += [last, *own[:-1]] if own else []
                    last = own[-1] if own else last
                    at += len(own)
                if len(toks) >= WORDS_AT_A_TIME:
                    yield table(b, owner, pos, toks, para, line, prev)
                    toks, owner, pos, para, line, prev = [], [], [], [], [], []
            yield table(b, owner, pos, toks, para, line, prev)

    def table(b: pa.RecordBatch, owner: list, pos: list, toks: list, para: list, line: list, prev: list) -> pa.RecordBatch:
        own = [pa.array(pos, pa.int32()), pa.array(toks, pa.string()), pa.array(para, pa.bool_()), pa.array(line, pa.bool_()), pa.array(prev, pa.string())]
        return pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(owner, pa.int64())), *own], names)

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    split = rows.mapInArrow(run, f"doc {kind}, pos int, tok string, parastart boolean, linestart boolean, prev_tok string")
    return words_of_tokens(split, parastart=F.col("parastart"), linestart=F.col("linestart"))


def words_of_tokens(tokens: DataFrame, doc: str = "doc", pos: str = "pos", tok: str = "tok", parastart: Column | None = None, linestart: Column | None = None) -> DataFrame:
    """The same table for tokens that are there already, native; lines and paragraphs only as far as they are given."""
    starts = {"parastart": F.lit(False) if parastart is None else parastart, "linestart": F.lit(False) if linestart is None else linestart}
    own = properties(F.col(tok))
    before = [F.col("prev_tok")] if "prev_tok" in tokens.columns else []
    columns = {"type": own.pop("type"), "period_final": own.pop("period_final")} | starts | own
    return tokens.select(F.col(doc).alias("doc"), F.col(pos).alias("pos"), F.col(tok).alias("tok"), *(c.alias(n) for n, c in columns.items()), *before)


def properties(t: Column) -> dict[str, Column]:
    """What is known of a word alone."""
    kind = token_type(t)
    first = F.substring(t, 1, 1)
    case = F.when(first.rlike(r"^\p{IsLowercase}"), "lower").when(first.rlike(r"^\p{IsUppercase}"), "upper").otherwise("none")
    return {
        "type": kind, "period_final": t.endswith("."), "is_number": kind.startswith(S.NUMBER), "is_initial": t.rlike(r"^(?U)[^\W\d]\.$"), "is_alpha": t.rlike(r"^(?U)[^\W\d]+$"),
        "is_non_punct": kind.rlike(r"(?U)[^\W\d]"), "case": case,
    }


def words_of_lists(docs: DataFrame, doc: str, toks: Column) -> DataFrame:
    """The word table of an array of each document's tokens, with the token before each as prev_tok: neighbours come from
    the array, so that no word is moved to find them."""
    rows = docs.select(F.col(doc).alias("doc"), toks.alias("t"))
    n = F.size("t")
    rows = rows.where(n > 0).select("doc", F.posexplode(F.arrays_zip(F.col("t").alias("tok"), F.concat(F.array(F.lit(None).cast("string")), F.slice("t", 1, n - 1)).alias("prev_tok"))).alias("pos", "w"))
    return words_of_tokens(rows.select("doc", "pos", F.col("w.tok").alias("tok"), F.col("w.prev_tok").alias("prev_tok")))


def token_type(tok: Column) -> Column:
    return F.when(tok.rlike(r"^(?U)-?[\.,]?\d[\d,\.-]*\.?$"), F.lit(S.NUMBER)).otherwise(F.lower(tok))


def type_counts(words: DataFrame) -> DataFrame:
    """type, n; keep_frequent() prunes it."""
    return words.groupBy("type").agg(F.count("*").alias("n"))


def keep_frequent(counts: DataFrame, least: int = 2, n: str = "n") -> DataFrame:
    return counts.where(F.col(n) >= least)


def merged_counts(*parts: DataFrame) -> DataFrame:
    """Counts of several corpora as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*[c for c in out.columns if c != "n"]).agg(F.sum("n").alias("n"))


def modified_dunning(a: Column, b: Column, ab: Column, total: Column) -> Column:
    """The likelihood ratio of an abbreviation: with its share of periods against 0.99."""
    p = b / total
    null = ab * F.log(p) + (a - ab) * F.log(1.0 - p)
    other = ab * F.log(F.lit(0.99)) + (a - ab) * F.log(1.0 - F.lit(0.99))
    return -2.0 * (null - other)


def collocation_ratio(a: Column, b: Column, ab: Column, total: Column) -> Column:
    p, p1, p2 = b / total, ab / a, F.try_divide(b - ab, total - a)
    one = ab * F.log(p) + (a - ab) * F.log(1.0 - p)
    two = (b - ab) * F.log(p) + (total - a - b + ab) * F.log(1.0 - p)
    three = F.when(a == ab, 0.0).otherwise(ab * F.log(p1) + (a - ab) * F.log(1.0 - p1))
    four = F.when(b == ab, 0.0).otherwise((b - ab) * F.log(p2) + (total - a - b + ab) * F.log(1.0 - p2))
    return -2.0 * (one + two - three - four)


def abbreviation_scores(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """type (without its period), score. totals: one row with n (words) and periods (words that end in one)."""
    ends = counts.where(F.col("type").endswith(".") & (F.length("type") > 1) & F.col("type").rlike(r"(?U)[^\W\d]") & (F.col("type") != S.NUMBER))
    with_period = ends.select(F.expr("substring(type, 1, length(type) - 1)").alias("type"), F.col("n").alias("with_n"))
    both = with_period.join(counts.select("type", F.col("n").alias("without_n")), "type", "left").na.fill(0, ["without_n"]).crossJoin(F.broadcast(totals))
    dots = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit(""))) + 1
    letters = F.length("type") - dots + 1
    ratio = modified_dunning(F.col("with_n") + F.col("without_n"), F.col("periods"), F.col("with_n"), F.col("n"))
    score = ratio * F.exp(-letters) * dots * F.pow(letters.cast("double"), -F.col("without_n"))
    return both.select("type", score.alias("score"))


def totals_of(words: DataFrame) -> DataFrame:
    return words.agg(F.count("*").alias("n"), F.sum(F.col("period_final").cast("long")).alias("periods"))


def adjoining(words: DataFrame) -> DataFrame:
    """before, tok, parastart, linestart, n: how often each word comes after each word with a final period; other words
    before it stand for their kind (null: none, "!" and "?": as they are, "x": any other, which ends
    nothing whatever it is).

    All that a model is learned from follows from this table, which is far smaller than the corpus: a word's neighbour is
    told apart only where it may have ended a sentence, and counts combine before they are moved.
    """
    if "prev_tok" not in words.columns:
        words = words.withColumn("prev_tok", F.lag("tok").over(Window.partitionBy("doc").orderBy("pos")))
    prev = F.col("prev_tok")
    kind = F.when(prev.isNull() | prev.endswith(".") | prev.isin(*S.SENTENCE_ENDS), prev).otherwise(F.lit("x"))
    return words.groupBy(kind.alias("before"), "tok", "parastart", "linestart").agg(F.count("*").alias("n"))


def with_properties(pairs: DataFrame) -> DataFrame:
    """adjoining pairs with both words' own properties."""
    own = lambda c: {name: e for name, e in properties(F.col(c)).items()}
    return pairs.withColumns(own("tok") | {f"prev_{n}": e for n, e in own("before").items()})


def annotated(pairs: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """pairs (see adjoining) with type, case, sentbreak, abbr, ellipsis, bare, key ... of the word, and of the one before
    it as prev_type ..."""
    known = abbreviations.select(F.col("type").alias("a"), F.lit(True).alias("hit")).distinct()
    if known.limit(BROADCAST_TYPES + 1).count() <= BROADCAST_TYPES:
        known = F.broadcast(known)
    w = with_properties(pairs)
    for tok, pre in (("tok", ""), ("before", "prev_")):
        t = F.col(tok)
        stem = F.lower(F.expr(f"substring({tok}, 1, length({tok}) - 1)"))
        single = F.col(f"{pre}period_final") & ~t.endswith("..") & ~t.isin(*S.SENTENCE_ENDS)
        w = w.withColumns({"__s": F.when(single, stem), "__p": F.when(single, F.element_at(F.split(stem, "-"), -1))})
        w = w.join(known.withColumnRenamed("hit", "h1"), F.col("__s") == F.col("a"), "left").drop("a")
        w = w.join(known.withColumnRenamed("hit", "h2"), F.col("__p") == F.col("a"), "left").drop("a")
        abbr = single & (F.col("h1").isNotNull() | F.col("h2").isNotNull())
        w = w.withColumns({f"{pre}abbr": abbr, f"{pre}ellipsis": t.rlike(r"^\.\.+$"), f"{pre}sentbreak": t.isin(*S.SENTENCE_ENDS) | single & ~abbr})
        kind = f"{pre}type"
        bare = F.when((F.length(kind) > 1) & F.col(kind).endswith("."), F.expr(f"substring({kind}, 1, length({kind}) - 1)")).otherwise(F.col(kind))
        w = w.withColumn(f"{pre}bare", bare).withColumn(f"{pre}key", F.when(F.col(f"{pre}sentbreak"), F.col(f"{pre}bare")).otherwise(F.col(kind)))
        w = w.drop("__s", "__p", "h1", "h2")
    return w


def contexts(pairs: DataFrame) -> DataFrame:
    """type, bits: the cases and places that each type was seen in. pairs: annotated."""
    ended = F.coalesce(F.col("prev_sentbreak"), F.lit(True))
    vague = F.coalesce(F.col("prev_is_number") | F.col("prev_is_initial"), F.lit(False))
    held = F.coalesce(F.col("prev_ellipsis") | F.col("prev_abbr"), F.lit(False))
    came = F.when(ended & ~vague, "initial").when(ended | held, "unknown").otherwise("internal")
    place = F.when(F.col("parastart") & (came != "unknown"), "initial").otherwise(came)
    place = F.when(F.col("linestart") & (place == "internal"), "unknown").otherwise(place)
    bits = {("initial", "upper"): S.BEGIN_UPPER, ("internal", "upper"): S.MIDDLE_UPPER, ("unknown", "upper"): S.UNKNOWN_UPPER, ("initial", "lower"): S.BEGIN_LOWER, ("internal", "lower"): S.MIDDLE_LOWER, ("unknown", "lower"): S.UNKNOWN_LOWER}
    bit = F.lit(0)
    for (p, c), b in bits.items():
        bit = F.when((place == p) & (F.col("case") == c), F.lit(b)).otherwise(bit)
    return pairs.select(F.col("key").alias("type"), bit.alias("bit")).where("bit > 0").groupBy("type").agg(F.bit_or("bit").alias("bits"))


def rare_abbreviations(pairs: DataFrame, counts: DataFrame, context_bits: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """type: words before a period that stand where no sentence can have ended."""
    pairs = pairs.where("prev_period_final and prev_sentbreak and not prev_abbr").select(F.col("prev_key").alias("type"), F.col("prev_bare").alias("found"), F.col("tok").alias("next_tok"), F.col("key").alias("next_key"), F.col("case").alias("next_case"))
    pairs = pairs.join(abbreviations.select("type"), "type", "left_anti")
    n = counts.select(F.col("type").alias("t"), F.col("n").alias("cn"))
    shorter = F.expr("substring(type, 1, length(type) - 1)")
    pairs = pairs.join(n.withColumnRenamed("cn", "n1"), F.col("type") == F.col("t"), "left").drop("t").withColumn("short", shorter)
    pairs = pairs.join(n.withColumnRenamed("cn", "n2"), F.col("short") == F.col("t"), "left").drop("t")
    pairs = pairs.where(F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0)) < RARE_BELOW)
    pairs = pairs.join(context_bits.select(F.col("type").alias("next_key"), "bits"), "next_key", "left")
    inside = F.substring("next_tok", 1, 1).isin(*S.INTERNAL)
    name = (F.col("next_case") == "lower") & (F.col("bits").bitwiseAND(S.BEGIN_UPPER) != 0) & (F.col("bits").bitwiseAND(S.MIDDLE_UPPER) == 0)
    return pairs.where(inside | name).select(F.col("found").alias("type")).distinct()


def starter_counts(pairs: DataFrame) -> DataFrame:
    found = pairs.where("prev_period_final and prev_sentbreak and not prev_is_number and not prev_is_initial and is_alpha")
    return found.groupBy("type").agg(F.sum("n").alias("n"))


def collocation_counts(pairs: DataFrame) -> DataFrame:
    found = pairs.where("prev_period_final and prev_is_non_punct and is_non_punct")
    return found.groupBy(F.col("prev_bare").alias("type1"), F.col("key").alias("type2")).agg(F.sum("n").alias("n"))


def _with_total(df: DataFrame, counts: DataFrame, column: str, out: str) -> DataFrame:
    """df with `out`, the count of the type in `column` with and without a period."""
    bare = counts.select(F.col("type").alias("__t"), F.col("n").alias("__n"))
    dotted = counts.where(F.col("type").endswith(".")).select(F.expr("substring(type, 1, length(type) - 1)").alias("__t"), F.col("n").alias("__n"))
    both = bare.unionByName(dotted).groupBy("__t").agg(F.sum("__n").alias(out))
    return df.join(both, F.col(column) == F.col("__t"), "left").drop("__t").na.fill(0, [out])


def sentence_starters(pairs: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """type, score of words that start sentences more often than chance has it."""
    breaks = pairs.agg(F.sum(F.when(F.col("sentbreak"), F.col("n")).otherwise(0)).alias("breaks"))
    c = _with_total(starter_counts(pairs), counts, "type", "all_n").crossJoin(F.broadcast(breaks)).crossJoin(F.broadcast(totals.select(F.col("n").alias("total"))))
    c = c.where("all_n >= n").withColumn("score", collocation_ratio(F.col("breaks"), F.col("all_n"), F.col("n"), F.col("total")))
    return c.where((F.col("score") >= STARTER) & (F.col("total") / F.col("breaks") > F.col("all_n") / F.col("n"))).select("type", "score")


def collocations(pairs: DataFrame, counts: DataFrame, totals: DataFrame, starters: DataFrame) -> DataFrame:
    """type1, type2, score of pairs around a period that belong together."""
    c = collocation_counts(pairs).join(starters.select(F.col("type").alias("type2")), "type2", "left_anti")
    c = _with_total(_with_total(c, counts, "type1", "n1"), counts, "type2", "n2").crossJoin(F.broadcast(totals.select(F.col("n").alias("total"))))
    c = c.where((F.col("n1") > 1) & (F.col("n2") > 1) & (F.col("n") > MIN_COLLOCATION) & (F.col("n") <= F.least("n1", "n2")))
    c = c.withColumn("score", collocation_ratio(F.col("n1"), F.col("n2"), F.col("n"), F.col("total")))
    return c.where((F.col("score") >= COLLOCATION) & (F.col("total") / F.col("n1") > F.col("n2") / F.col("n"))).select("type1", "type2", "score")


@dataclass
class Learned:
    """A model as tables: abbreviations (type), starters (type, score), collocations (type1, type2, score), contexts (type, bits)."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame
    contexts: DataFrame
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Give up what was persisted; the tables can still be computed."""
        for df in self.held:
            df.unpersist()

    def model(self, max_types: int = MAX_TYPES) -> S.Model:
        """The record for the workers; a vocabulary over max_types is an error (prune with learn(least=...))."""
        rows = self.contexts.limit(max_types + 1).collect()
        if len(rows) > max_types:
            raise ValueError(f"the model has more than {max_types} types; learn it with a higher `least`")
        return S.Model(frozenset(r[0] for r in self.abbreviations.select("type").collect()), frozenset((r[0], r[1]) for r in self.collocations.select("type1", "type2").collect()), frozenset(r[0] for r in self.starters.select("type").collect()), {r["type"]: r["bits"] for r in rows})

    def save(self, path: str) -> None:
        for name in ("abbreviations", "starters", "collocations", "contexts"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Learned:
    return Learned(*(spark.read.parquet(f"{path}/{n}") for n in ("abbreviations", "starters", "collocations", "contexts")))


def learn(words: DataFrame, least: int = 1, keep: bool = True) -> Learned:
    """A model from a word table; least: types seen less often keep no context.

    The corpus is read once, into a table of adjoining words (see there); that and its annotations, which several steps
    read, are stored in the shared folder. keep: counts are persisted too (on disk if need be) until Learned.release();
    without it they are computed again, for uses that take one of the model's tables.
    """
    pairs = stored(adjoining(words))
    kind = token_type(F.col("tok"))
    each = pairs.select(kind.alias("type"), F.col("tok").endswith(".").alias("period_final"), "n")
    counts = each.groupBy("type").agg(F.sum("n").alias("n"))
    counts = counts.persist() if keep else counts
    totals = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.when(F.col("period_final"), F.col("n")).otherwise(0)).alias("periods"))
    frequent = abbreviation_scores(counts, totals).where(F.col("score") >= ABBREVIATION).select("type")
    marked = stored(annotated(pairs, frequent).select(*ANNOTATIONS))
    bits = contexts(marked)
    rare = rare_abbreviations(marked, counts, bits, frequent)
    starters = sentence_starters(marked, counts, totals)
    both = collocations(marked, counts, totals, starters)
    if least > 1:
        bits = bits.join(keep_frequent(counts, least).select("type"), "type", "left_semi")
    return Learned(frequent.unionByName(rare).distinct(), starters, both, bits, (counts,) if keep else ())


def model_of_texts(spark: SparkSession, texts: list[str], least: int = 1) -> S.Model:
    """The record of a model that is learned from texts at hand."""
    rows = spark.createDataFrame(list(enumerate(texts)), "doc long, t string")
    learned = learn(word_table(rows.select("doc", training_text(F.col("t")).alias("t")), "doc", "t"), least)
    try:
        return learned.model()
    finally:
        learned.release()


def training_text(text: Column) -> Column:
    """Stripped, and with a period at the end."""
    t = F.trim(text)
    return F.when(t.endswith("."), t).otherwise(F.concat(t, F.lit(".")))
