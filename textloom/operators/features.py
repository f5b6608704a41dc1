"""Corpus statistics and features as long tables (doc, term, value), and sequences of word ids.

Vectors are sparse long tables until a learner needs them; vocabularies are joined, never collected.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import stored
from .ranking import ranked
from .text import as_column

#: Words that are coded by one list of terms, about.
GROUP_WORDS = 2_000_000

#: Pairs of words that a task adds up at a time, about.
GROUP_PAIRS = 8_000_000

#: Classes of terms, by a hash; sums of pairs are dealt over the square of it.
CELL_SIDE = 20

# Fixed value: characters that split words in the sequence helpers.
BASE_FILTER = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'


def flatten_sentences(column: Column | str) -> Column:
    return F.flatten(as_column(column))


def token_table(docs: DataFrame, id_col: str, tokens: Column | str) -> DataFrame:
    """doc, pos, term of an array<string> column."""
    return docs.select(F.col(id_col).alias("doc"), F.posexplode(as_column(tokens)).alias("pos", "term"))


def without_stop_words(tokens: DataFrame, stop_words: list[str], term: str = "term") -> DataFrame:
    """The rows of a token table whose term is no stop word; the list's size bounds what is broadcast."""
    spark = tokens.sparkSession
    words = spark.createDataFrame([(w,) for w in stop_words], "__w string")
    if len(stop_words) <= 100_000:
        words = F.broadcast(words)
    return tokens.join(words, F.col(term) == F.col("__w"), "left_anti")


def filter_stop_words(column: Column | str, stop_words: list[str]) -> Column:
    return F.filter(as_column(column), lambda w: ~w.isin(*stop_words)) if stop_words else as_column(column)


def english_stop_words() -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def term_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc", "term").agg(F.count("*").alias("tf"))


def word_frequencies(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("term").agg(F.count("*").alias("n"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    """term, df of a (doc, term, ...) table with one row a pair."""
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def term_dictionary(counts: DataFrame) -> DataFrame:
    """term, id: ids from 0 in the terms' order."""
    terms = counts.select("term").distinct().withColumn("__p", F.substring("term", 1, 2))
    return ranked(terms, [("__p", F.col("__p"))], [F.col("term")], "id").select("term", (F.col("id") - 1).alias("id"))


def tfidf(counts: DataFrame, fitted_on: DataFrame | None = None) -> DataFrame:
    """doc, term, tfidf: raw counts times ln((1 + n) / (1 + df)) + 1, rows of unit length.

    fitted_on: the counts whose documents give n and df; those of `counts` if left out. Terms unknown there are dropped.
    """
    base = counts if fitted_on is None else fitted_on
    n = base.agg(F.count_distinct("doc").alias("n_docs"))
    idf = document_frequencies(base).crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counts.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    # A document's length is a window over its terms: the weights are made and dealt out by document once.
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return raw.select("doc", "term", F.try_divide("w", norm).alias("tfidf"))


def binary_bag(tokens: DataFrame) -> DataFrame:
    """doc, term, value 1 for each term a document has."""
    return tokens.select("doc", "term").distinct().withColumn("value", F.lit(1))


def first_seen_vocabulary(tokens: DataFrame) -> DataFrame:
    """term, id: ids from 0 in the order in which terms are first seen (by doc, then pos) in a token table or coded()."""
    tokens = tokens.where("term is not null") if "code" in tokens.columns else tokens
    first = tokens.groupBy("term").agg(F.min(F.struct("doc", "pos")).alias("at")).select("term", "at.doc", "at.pos")
    return ranked(first, [("doc", F.col("doc"))], [F.col("pos")], "id").select("term", (F.col("id") - 1).alias("id"))


def encoded(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc, ids: each document's known words as ids, in order."""
    pairs = tokens.join(vocabulary, "term").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("x"))
    return pairs.select("doc", F.transform("x", lambda x: x["id"]).alias("ids"))


def coded(docs: DataFrame) -> DataFrame:
    """Documents (doc, words) as codes, stored; for vocabularies and sequences that must not move each word.

    Groups of documents of about GROUP_WORDS words have a list of terms each. Rows of two kinds: a document's grp and codes;
    a term's grp and code, n (how often), docs (in how many documents), and the doc and pos that it is first seen at. Only
    the terms of groups, far fewer than words, are moved to meet a vocabulary. Documents of one id are put together.
    """
    kind = docs.schema["doc"].dataType.simpleString()
    names = ["grp", "doc", "codes", "term", "code", "n", "docs", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, held, size = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            held.append(b)
            size += len(b.column("words").flatten())
            if size >= GROUP_WORDS:
                yield from group(grp, pa.Table.from_batches(held))
                grp, held, size = grp + 1, [], 0
        if size:
            yield from group(grp, pa.Table.from_batches(held))

    def group(grp: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.take(pc.sort_indices(rows["doc"], null_placement="at_start"))
        doc, lists = pa.chunked_array(rows["doc"]).combine_chunks(), pa.chunked_array(rows["words"]).combine_chunks()
        found = pc.dictionary_encode(lists.flatten())
        codes, terms = found.indices.to_numpy(zero_copy_only=False), found.dictionary
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        first = np.zeros(len(terms), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]  # the last one written is the first seen
        seen_in, seen = np.divmod(np.unique(owner * np.int64(len(terms)) + codes), np.int64(len(terms)))
        own = np.bincount(seen[doc.is_valid().to_numpy(zero_copy_only=False)[seen_in]], minlength=len(terms))  # an id that is null counts for none
        no = lambda n, t: pa.nulls(n, t)
        n, at = len(doc), owner[first]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, grp)), doc, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes, pa.int32())), no(n, pa.string()), no(n, pa.int32()), no(n, pa.int64()), no(n, pa.int64()), no(n, pa.int32())], names)
        n = len(terms)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, grp)), doc.take(pa.array(at)), no(n, pa.list_(pa.int32())), terms, pa.array(np.arange(n), pa.int32()), pa.array(np.bincount(codes, minlength=n)), pa.array(own), pa.array(first - ends[at], pa.int32())], names)

    full = docs.select("doc", "words").where(F.size("words") > 0)
    out = stored(full.mapInArrow(run, f"grp bigint, doc {kind}, codes array<int>, term string, code int, n bigint, docs bigint, pos int"))
    if out.where("codes is not null").groupBy("doc").count().where("count > 1").limit(1).count():
        tokens = token_table(full, "doc", "words").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("x"))
        return coded(tokens.select("doc", F.transform("x", lambda x: x["term"]).alias("words")))
    return out


def decoded(codes: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc, ids of coded() documents, as encoded() has them."""
    kind = codes.schema["doc"].dataType.simpleString()

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        lists = pa.chunked_array(rows["codes"]).combine_chunks()
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        ids = np.full(int(flat.max(initial=-1)) + 1, -1, np.int64)
        ids[known["code"].to_numpy()] = known["id"].to_numpy()
        own = ids[flat]
        left = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[own >= 0], minlength=len(sizes))
        ends = np.concatenate([[0], np.cumsum(left)])
        out = pa.table({"doc": rows["doc"], "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own[own >= 0]))})
        return out.filter(pa.array(left > 0))

    known = codes.where("term is not null").select("grp", "code", "term").join(vocabulary.select("term", "id"), "term").select(F.col("grp").alias("__grp"), "code", "id")
    docs = codes.where("codes is not null").select("grp", "doc", "codes")
    return docs.groupBy("grp").cogroup(known.groupBy("__grp")).applyInArrow(run, f"doc {kind}, ids array<bigint>")


def sentence_labels(docs: DataFrame, id_col: str, sentences: str, which: tuple[str, ...] = ("sentence", "document"), split: bool = True) -> DataFrame:
    """words, labels: SENT_d_s and DOC_d for each sentence; without split one row a document, its sentences joined."""
    rows = docs.select(F.col(id_col).alias("doc"), F.posexplode(sentences).alias("s", "words")) if split else docs.select(F.col(id_col).alias("doc"), F.lit(0).alias("s"), F.flatten(sentences).alias("words"))
    text = lambda c: F.col(c).cast("string")
    labels = [F.concat_ws("_", F.lit("SENT"), text("doc"), text("s"))] * ("sentence" in which) + [F.concat_ws("_", F.lit("DOC"), text("doc"))] * ("document" in which)
    return rows.select("doc", "s", "words", F.array(*labels).alias("labels"))


def training_sentences(docs: DataFrame, sentences: str, split: bool) -> DataFrame:
    return docs.select(F.explode(sentences).alias("words")) if split else docs.select(F.flatten(sentences).alias("words"))


def count_token(column: Column | str, token: str) -> Column:
    return F.size(F.filter(as_column(column), lambda x: x == token))


def count_prefix(column: Column | str, prefix: str) -> Column:
    return F.size(F.filter(as_column(column), lambda x: x.startswith(prefix)))


# Sequence helpers.


def text_words(column: Column | str, filters: str = BASE_FILTER, lower: bool = True, split: str = " ") -> Column:
    """Native: the filters' characters become the separator, empty words are dropped."""
    t = F.lower(as_column(column)) if lower else as_column(column)
    t = F.translate(t, filters, split * len(filters))
    return F.filter(F.split(t, f"\\Q{split}\\E"), lambda w: w != "")


def hashed_ids(column: Column | str, n: int, hash_of: Callable[[Column], Column] = F.xxhash64) -> Column:
    """Native: 1 to n - 1 for each word of an array, by a hash (a long); words may share one."""
    return F.transform(as_column(column), lambda w: F.pmod(hash_of(w), F.lit(n - 1)) + 1)


def word_index(tokens: DataFrame) -> DataFrame:
    """term, n, docs, id: ids from 1 by falling frequency, then by word; of a token table or coded()."""
    if "code" in tokens.columns:
        stats = tokens.where("term is not null").groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    else:
        stats = tokens.groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("docs"))
    stats = stats.withColumn("__p", F.substring("term", 1, 1))
    return ranked(stats, [("n", F.desc("n")), ("__p", F.col("__p"))], [F.col("term")], "id").select("term", "n", "docs", "id")


def sequences(tokens: DataFrame, index: DataFrame, nb_words: int | None = None) -> DataFrame:
    """doc, ids: known words' ids in order; ids from nb_words on are dropped. tokens: a token table or coded()."""
    return (decoded if "code" in tokens.columns else encoded)(tokens, index.where(F.col("id") < nb_words).select("term", "id") if nb_words else index.select("term", "id"))


def id_documents(seqs: DataFrame) -> DataFrame:
    """id, docs: in how many sequences an id stands."""
    return seqs.select(F.explode(F.array_distinct("ids")).alias("id")).groupBy("id").agg(F.count("*").alias("docs"))


def sequence_matrix(seqs: DataFrame, mode: str, nb_words: int, docs: DataFrame | None = None, n_docs: int | None = None) -> DataFrame:
    """doc, id, value of the ids below nb_words; mode: binary, count, freq or tfidf.

    freq and tfidf divide by the whole sequence's length. tfidf: ln(freq) / (1 + ln(1 + df / (n_docs + 1))), with docs (id, docs).
    """
    if mode not in ("binary", "count", "freq", "tfidf"):
        raise ValueError(f"no such mode: {mode}")
    if mode == "tfidf" and (docs is None or n_docs is None):
        raise ValueError("tfidf needs the documents that ids stand in; fit first")
    kind = seqs.schema["doc"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document's ids are in its row, so that none is moved to be counted."""
        for b in batches:
            sizes = pc.fill_null(pc.list_value_length(b.column("ids")), 0).to_numpy(zero_copy_only=False)
            ids, row = b.column("ids").flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
            ids, row = ids[ids < nb_words], row[ids < nb_words]
            cells, n = np.unique(np.stack([row, ids]), axis=1, return_counts=True) if ids.min(initial=0) < 0 else np.unique(row * np.int64(nb_words) + ids, return_counts=True)
            row, ids = cells if cells.ndim == 2 else np.divmod(cells, np.int64(nb_words))
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(row)), pa.array(sizes[row], pa.int32()), pa.array(ids), pa.array(n)], ["doc", "len", "id", "c"])

    cells = seqs.select("doc", "ids").mapInArrow(count, f"doc {kind}, len int, id bigint, c bigint") if nb_words > 0 else seqs.sparkSession.createDataFrame([], f"doc {kind}, len int, id bigint, c bigint")
    value = {"binary": F.lit(1.0), "count": F.col("c").cast("double"), "freq": F.col("c") / F.col("len")}
    if mode == "tfidf":
        cells = cells.join(docs.withColumnRenamed("docs", "df"), "id", "left").na.fill(0, ["df"])
        value["tfidf"] = F.log(F.col("c") / F.col("len")) / (1 + F.log(1 + F.col("df") / (n_docs + 1)))
    return cells.select("doc", "id", value[mode].alias("value"))


def pad_sequence(column: Column | str, length: int, padding: str = "pre", truncating: str = "pre", value: float = 0) -> Column:
    """Native: an array cut and filled to length; padding and truncating at its beginning (pre) or end (post)."""
    if padding not in ("pre", "post") or truncating not in ("pre", "post"):
        raise ValueError("padding and truncating are pre or post")
    ids = as_column(column)
    n = F.size(ids)
    kept = F.when(n <= length, ids).otherwise(F.slice(ids, n - length + 1, F.lit(length)) if truncating == "pre" else F.slice(ids, 1, length))
    fill = F.array_repeat(F.lit(value).cast("int"), F.lit(length) - F.size(kept))
    kept = kept.cast("array<int>")
    return F.concat(fill, kept) if padding == "pre" else F.concat(kept, fill)


def longest(df: DataFrame, column: str) -> int:
    return df.agg(F.max(F.size(column))).first()[0] or 0


def sampling_probability(rank: Column, factor: float = 1e-5) -> Column:
    """How likely the word of a frequency rank is kept; rank 0 counts as 1."""
    r = F.greatest(rank.cast("double"), F.lit(1.0))
    inverse = factor * (r * (F.log(r) + 0.577) + 0.5 - 1.0 / (12.0 * r))
    return F.least(F.lit(1.0), F.sqrt(inverse))


def sampling_table(spark, size: int, factor: float = 1e-5) -> DataFrame:
    return spark.range(size).select(F.col("id").alias("rank"), sampling_probability(F.col("id"), factor).alias("p"))


def skipgram_pairs(seqs: DataFrame, window: int = 4, keep: Column | None = None) -> DataFrame:
    """doc, word, context, label 1: pairs of ids at most `window` apart; id 0 is skipped.

    Each word's neighbours are a slice of its own sequence, so that no join is needed. keep: a condition on `word`.
    """
    at = seqs.select("doc", "ids", F.posexplode("ids").alias("i", "word")).where("word <> 0")
    if keep is not None:
        at = at.where(keep)
    left = F.greatest(F.col("i") - window, F.lit(0))
    near = F.concat(F.slice("ids", left + 1, F.col("i") - left), F.slice("ids", F.col("i") + 2, F.lit(window)))
    return at.select("doc", "word", F.explode(near).alias("context")).where("context <> 0").withColumn("label", F.lit(1))


def skipgram_negatives(pairs: DataFrame, vocabulary: int, ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """As many pairs times ratio with a random context and label 0 (or one more, by chance, for a fraction)."""
    whole = F.floor(F.lit(ratio) + F.rand(seed)).cast("int")
    again = pairs.withColumn("__k", F.explode(F.array_repeat(F.lit(0), whole))).drop("__k")
    return again.withColumn("context", (F.rand(seed + 1) * (vocabulary - 1)).cast("long") + 1).withColumn("label", F.lit(0))


def one_hot_label(label: Column | str) -> Column:
    c = as_column(label)
    return F.array((c == 0).cast("int"), (c == 1).cast("int"))


def skipgrams(seqs: DataFrame, vocabulary: int, window: int = 4, ratio: float = 1.0, seed: int = 0, shuffle: bool = True, categorical: bool = False, table: bool = False, factor: float = 1e-5) -> DataFrame:
    """Positive and negative pairs, in random order; table: frequent words are kept with sampling_probability()."""
    keep = sampling_probability(F.col("word"), factor) >= F.rand(seed + 2) if table else None
    pos = skipgram_pairs(seqs, window, keep)
    out = pos.unionByName(skipgram_negatives(pos, vocabulary, ratio, seed)) if ratio > 0 else pos
    if categorical:
        out = out.withColumn("label", one_hot_label("label"))
    return out.orderBy(F.rand(seed + 3)) if shuffle else out


def cooccurrences(tokens: DataFrame, window: int = 40) -> DataFrame:
    """term, other, weight: 1 / distance summed over pairs of words of a document at most window apart, each pair of terms once.

    tokens: a token table or documents (doc, words), of which no word is moved. Tasks add up GROUP_PAIRS pairs at a time and
    send the sums on in cells, by a hash of each of the two terms, packed as codes with the cell's terms. Sums are whole
    numbers of the distances' common part where that is small. Without an id there are no pairs; rows of one id are pairs with
    one another too, by their words' places.
    """
    step, unit = max(1, GROUP_PAIRS // window), math.lcm(*range(1, window + 1))
    exact = unit <= 1 << 20
    shares = np.array([unit // k for k in range(1, window + 1)]) if exact else 1 / np.arange(1, window + 1)
    shift = (window - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            words, start = b.column("words"), 0
            ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            while start < len(ends):
                before = ends[start - 1] if start else 0
                end = int(np.searchsorted(ends, before + step - size, side="right"))
                if end == start and held:  # the next one is too long
                    yield from group(held)
                    held, size = [], 0
                    continue
                end = max(end, start + 1)
                held.append(words.slice(start, end - start))
                size, start = size + ends[end - 1] - before, end
        if size:
            yield from group(held)

    def group(lists: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        words = pa.chunked_array(lists).combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        found = pc.dictionary_encode(words.flatten())
        order = pc.sort_indices(found.dictionary)
        terms, rank = found.dictionary.take(order), np.full(len(order) + 1, -1)  # the last one is that of no word
        rank[order.to_numpy()] = np.arange(len(order))
        codes = rank[pc.fill_null(found.indices, -1).to_numpy(zero_copy_only=False)]
        side = np.fromiter((zlib.crc32(t) % CELL_SIDE for t in terms.cast(pa.binary()).to_pylist()), np.uint16, len(terms))
        bits, n = max(1, len(terms).bit_length()), len(codes)
        for start in range(0, n, step):
            keys, size = np.empty(min(step, n - start) * window, np.int64), 0
            for k in range(1, window + 1):
                end = max(start, min(start + step, n - k))
                a, b = codes[start:end], codes[start + k : end + k]
                near = (owner[start:end] == owner[start + k : end + k]) & (np.minimum(a, b) >= 0)
                a, b = a[near], b[near]
                keys[size : size + len(a)] = (np.minimum(a, b) << bits | np.maximum(a, b)) << shift | k - 1
                size += len(a)
            keys = keys[:size]
            keys.sort()
            if size:
                first = np.concatenate([[0], np.flatnonzero((keys[1:] ^ keys[:-1]) >> shift) + 1])
                pairs = keys[first] >> shift
                keys &= (1 << shift) - 1
                sums = np.add.reduceat(shares.take(keys, out=keys) if exact else shares[keys], first)
                del keys, first
                yield from cells((pairs >> bits).astype(np.int32), (pairs & ((1 << bits) - 1)).astype(np.int32), sums, terms, side)

    def cells(one: np.ndarray, two: np.ndarray, sums: np.ndarray, terms: pa.Array, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        cell = side[one] * np.uint16(CELL_SIDE) + side[two]
        order = np.argsort(cell, kind="stable")
        ends = np.cumsum(np.bincount(cell, minlength=CELL_SIDE**2))
        one, two, sums = one[order], two[order], sums[order]
        for c, (start, end) in enumerate(zip([0, *ends], ends)):
            if start < end:
                own, at = np.unique(np.concatenate([one[start:end], two[start:end]]), return_inverse=True)
                at, own_sums = at.astype(np.min_scalar_type(len(own))), sums[start:end]
                a, b = at[: end - start], at[end - start :]
                a = np.diff(a, prepend=a.dtype.type(0))  # ascending
                columns = [terms.take(pa.array(own)), *map(pa.array, (a, b, own_sums.astype(np.min_scalar_type(own_sums.max())) if exact else own_sums))]
                packed = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns], ["terms", "one", "two", "sums"])
                with pa.BufferOutputStream() as out:
                    with pa.ipc.new_stream(out, packed.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_batch(packed)
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["cell", "packed"])

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, sums = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys, kind="stable")
        keys, sums = keys[order], sums[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[first], np.add.reduceat(sums, first)

    def merged(rows: pa.Table) -> pa.Table:
        parts = [pa.ipc.open_stream(x.as_buffer()).read_next_batch() for x in rows["packed"].combine_chunks()]
        take = lambda p, c: p.column(c).flatten()
        found = pc.dictionary_encode(pa.concat_arrays([take(p, "terms") for p in parts]))
        codes, held, at, size, most = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), [], 0, 0, step
        for p in parts:
            own = codes[at : at + len(take(p, "terms"))]
            at += len(own)
            held.append((own[np.cumsum(take(p, "one").to_numpy(), dtype=np.int64)] << 32 | own[take(p, "two").to_numpy()], take(p, "sums").to_numpy().astype(shares.dtype)))
            size += len(held[-1][0])
            if size > most:
                held = [added(held)]
                size = len(held[0][0])
                most = 2 * size + step
        keys, sums = added(held)
        term, other = (found.dictionary.take(pa.array(c)) for c in (keys >> 32, keys & 0xFFFFFFFF))
        return pa.table({"term": term, "other": other, "weight": sums / unit if exact else sums})

    listed = "words" in tokens.columns
    docs = tokens.where("doc is not null")
    if not listed:
        docs = docs.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("words"))
    sums = docs.select("words").mapInArrow(run, "cell int, packed binary")
    out = sums.groupBy("cell").applyInArrow(merged, "term string, other string, weight double")
    again = docs.groupBy("doc").count().where("count > 1")
    if listed and again.limit(1).count():
        rows = docs.join(again, "doc", "left_semi").groupBy("doc").agg(F.collect_list("words").alias("lists"))
        at = rows.select("lists", F.posexplode("lists").alias("r", "x")).select("lists", "r", F.posexplode("x").alias("i", "a"))
        near = at.select("r", "i", "a", F.posexplode("lists").alias("s", "x")).where("r <> s")
        near = near.select("a", F.posexplode(F.slice("x", F.col("i") + 2, F.lit(window))).alias("d", "b")).where("a is not null and b is not null")
        between = near.select(F.least("a", "b").alias("term"), F.greatest("a", "b").alias("other"), (1.0 / (F.col("d") + 1)).alias("weight"))
        out = out.unionByName(between).groupBy("term", "other").agg(F.sum("weight").alias("weight"))
    return out
