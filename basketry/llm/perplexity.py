"""Quality by perplexity under an interpolated modified Kneser-Ney model of byte 5-grams.

The model is trained on the trusted documents (label quality 1 and not toxic) but one in five,
chosen by a hash of the id; those set the thresholds.  Its tokens are the bytes of the text, so every
word of any language is seen as it is spelled, and there is no vocabulary and no unknown class.

Scoring joins counts, not occurrences, and the text moves once:

1. documents become chunks of some megabytes, written in buckets of the chunk number;
2. each chunk gives its distinct 5-grams with their count in its trusted documents, packed by
   shard of the 5-gram; a shard's task adds them up;
3. lower orders are the continuation counts of that table.  Going up from single bytes, an order's
   n-grams pick up their count, their context's sum and discounted mass, and the probability of
   their suffix; a context has at most 256 continuations and a suffix 256 extensions, so no key
   of these joins is hot;
4. a shard's probabilities go back to the chunks in the order in which the chunks sent their
   5-grams, and meet the chunk's text in its bucket, where the documents' sums are formed.

No table of the model is collected or broadcast by hand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import SPACES, Scratch
from basketry.llm.packed import by_shard, pack, steps, unpack, unsteps

ORDER = 5
BITS = 8
QUANTILE = 0.995
CHUNK_BYTES = 8_000_000
CHUNK_DOCS = 20_000  # below 2**DOC_BITS
DOC_BITS = 64 - ORDER * BITS
SLICE = 1 << 21  # bytes that are sorted at once
SHARDS = 4096  # at most; a shard holds its distinct 5-grams
HELD_OUT = 5  # one trusted document in so many is left out of training and sets the thresholds
LEAST_TRUSTED = 30  # held-out documents a language needs for a threshold of its own


def tokens(text: str | None) -> bytes:
    """The bytes of a text without the white space around it."""
    return (text or "").strip(SPACES).encode()


def grams(data: np.ndarray, lengths: np.ndarray, start: int, end: int) -> np.ndarray:
    """Codes of the bytes ``start`` to ``end``: each with the four before it in its document (0 before the first)."""
    lead = max(0, start - ORDER + 1)
    x = data[lead:end].astype(np.uint64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    low, high = (int(np.searchsorted(ends, at, side="right")) for at in (start, end - 1))
    inside = np.minimum(ends[low : high + 1], end) - np.maximum(begins[low : high + 1], start)
    doc = np.repeat(np.arange(low, high + 1), inside)
    at = np.arange(start, end) - begins[doc]
    codes = x[start - lead :].copy()
    for back in range(1, ORDER):
        known = min(back, start - lead)
        before = np.zeros(end - start, np.uint64)
        before[back - known :] = x[start - lead - known : max(0, len(x) - back)]
        before[at < back] = 0
        codes |= before << np.uint64(BITS * back)
    return codes << np.uint64(DOC_BITS) | doc.astype(np.uint64)


def runs(data: np.ndarray, lengths: np.ndarray):
    """(codes, documents, times) of the distinct (5-gram, document) pairs, slice by slice, sorted by code."""
    for start in range(0, len(data), SLICE):
        keys = np.sort(grams(data, lengths, start, min(start + SLICE, len(data))))
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        times = np.diff(np.r_[first, len(keys)])
        keys = keys[first]
        yield keys >> np.uint64(DOC_BITS), (keys & np.uint64((1 << DOC_BITS) - 1)).astype(np.int64), times


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, with the sums of their counts."""
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.add.reduceat(counts, first)


def distinct_grams(data: np.ndarray, lengths: np.ndarray, trusted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's distinct codes and their counts in its trusted documents."""
    parts = [summed(codes, times * trusted[doc]) for codes, doc, times in runs(data, lengths)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return parts[0] if len(parts) == 1 else summed(*(np.concatenate(x) for x in zip(*parts)))


CHUNK = "chunk bigint, keys array<struct<id:{id},h:bigint>>, langs array<string>, lengths array<int>, data binary"


def chunks(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """Rows of up to ``CHUNK_BYTES`` bytes of text (or one longer document)."""
    schema = CHUNK.format(id=docs.schema[doc_id].dataType.simpleString())

    def work(batches):
        from pyspark import TaskContext

        no, count = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []

        def closed():
            keys, langs, texts = zip(*held)
            cells = [no, list(keys), list(langs), [len(t) for t in texts], zstandard.compress(b"".join(texts), 3)]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)], ["chunk", "keys", "langs", "lengths", "data"])

        kinds = None
        for b in batches:
            kinds = kinds or [pa.int64(), pa.list_(pa.struct([("id", b.schema.field(0).type), ("h", pa.int64())])),
                              pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]
            for key, h, lang_, t in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                data = tokens(t.as_py())
                if held and (count + len(data) > CHUNK_BYTES or len(held) >= CHUNK_DOCS):
                    yield closed()
                    held, count, no = [], 0, no + 1
                held.append(({"id": key, "h": h}, lang_, data))
                count += len(data)
        if held:
            yield closed()

    return docs.select(F.col(doc_id), F.xxhash64(text).alias("h"), F.col(lang), F.col(text)).mapInArrow(work, schema)


def _text_of(blob: bytes) -> np.ndarray:
    return unpack(blob, np.uint8)


def chunk_grams(parts: DataFrame, shards: int) -> DataFrame:
    """(shard, chunk, codes, counts): the chunk's distinct 5-grams of a shard and their trusted counts, packed."""

    def work(batches):
        for b in batches:
            for chunk, lengths, trusted, blob in zip(*(b.column(i).to_pylist() for i in range(4))):
                good = np.zeros(len(lengths), np.int64)
                good[trusted or []] = 1
                codes, counts = distinct_grams(_text_of(blob), np.asarray(lengths, np.int64), good)
                order, first, shard = by_shard(codes, shards)
                cells = [(s, chunk, steps(codes[o]), pack(counts[o].astype("<i8"))) for s, o in zip(shard.tolist(), np.split(order, first[1:]))]
                if cells:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), [pa.int64(), pa.int64(), pa.binary(), pa.binary()])],
                                                     ["shard", "chunk", "codes", "counts"])

    return parts.select("chunk", "lengths", "trusted", "data").mapInArrow(work, "shard bigint, chunk bigint, codes binary, counts binary")


def shard_counts(packed: DataFrame, shards: int, held: int = 1 << 21) -> DataFrame:
    """(shard, code, n): the distinct 5-grams of all chunks with their trusted counts."""

    def work(batches):
        shard, codes, counts, waiting = None, [], [], 0

        def added():
            return summed(np.concatenate(codes), np.concatenate(counts))

        def rows():
            c, n = added()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(c), shard)), pa.array(c.astype(np.int64)), pa.array(n)], ["shard", "code", "n"])

        for b in batches:
            for s, c, n in zip(*(col.to_pylist() for col in b.columns)):
                if s != shard:
                    if codes:
                        yield rows()
                    shard, codes, counts, waiting = s, [], [], 0
                codes.append(unsteps(c))
                counts.append(unpack(n, "<i8"))
                waiting += len(codes[-1])
                if waiting > held:
                    one = added()
                    codes, counts, waiting = [one[0]], [one[1]], 0
        if codes:
            yield rows()

    dealt = packed.select("shard", "codes", "counts").repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(work, "shard bigint, code bigint, n bigint")


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts of counts 1, 2 and over from the counts of counts; halves of it where there are too few."""
    n = counts.agg(*(F.sum((F.col("n") == i).cast("long")) for i in range(1, 5))).first()
    n1, n2, n3, n4 = (float(x or 0) for x in n)
    if min(n1, n2, n3) == 0:
        return [0.5, 0.75, 1.0]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


def _taken(count: Column, d: list[float]) -> Column:
    return F.when(count == 1, d[0]).when(count == 2, d[1]).when(count > 2, d[2]).otherwise(0.0)


def _suffix(code: Column, order: int) -> Column:
    """The last ``order`` bytes of a code."""
    return code.bitwiseAND(F.lit((1 << (BITS * order)) - 1))


def log_probabilities(counted: DataFrame) -> DataFrame:
    """(shard, code, logp) for every code of ``counted`` (shard, code, n), n being the trusted count."""
    scratch = Scratch(counted.sparkSession, "perplexity")
    code = F.col("code")
    counts, every = {ORDER: counted.filter("n > 0").select("code", "n")}, {ORDER: counted.select("code")}
    for k in range(ORDER - 1, 0, -1):
        counts[k], _ = scratch.pin(counts[k + 1].groupBy(_suffix(code, k).alias("code")).agg(F.count(F.lit(1)).alias("n")))
        every[k], _ = scratch.pin(every[k + 1].select(_suffix(code, k).alias("code")).distinct())
    n = F.coalesce("n", F.lit(0))
    d = _discounts(counts[1])
    total, left, types = (float(x or 0) for x in counts[1].agg(F.sum("n"), F.sum(_taken(F.col("n"), d)), F.count(F.lit(1))).first())
    total = total or 1.0
    priced = every[1].join(counts[1], "code", "left").select(
        "code", ((n - _taken(n, d)) / total + ((left or 1.0) / total) / (types + 1)).alias("p"))
    for k in range(2, ORDER + 1):
        d = _discounts(counts[k])
        context = F.shiftright("code", BITS)
        sums = counts[k].groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(_taken(F.col("n"), d)).alias("left"))
        lower = priced.select(F.col("code").alias("suffix"), F.col("p").alias("lower"))
        joined = (every[k].withColumns({"context": context, "suffix": _suffix(code, k - 1)})
                  .join(counts[k], "code", "left").join(sums, "context", "left").join(lower, "suffix"))
        p = F.when(F.col("total") > 0, (n - _taken(n, d) + F.col("left") * F.col("lower")) / F.col("total")).otherwise(F.col("lower"))
        priced, _ = scratch.pin(joined.select("code", p.alias("p")))
    return counted.select("shard", "code").join(priced.select("code", F.ln("p").alias("logp")), "code")


def chunk_prices(packed: DataFrame, priced: DataFrame, shards: int) -> DataFrame:
    """(chunk, shard, logp): log probabilities in the order of the 5-grams that a chunk sent to a shard."""

    def work(batches):
        shard, codes, logp = None, [], []
        for b in batches:
            cells = []
            for s, kind, c, p, chunk, blob in zip(*(col.to_pylist() for col in b.columns)):
                if s != shard:
                    shard, codes, logp = s, [], []
                if kind == 0:
                    codes.append(c)
                    logp.append(p)
                    continue
                if isinstance(codes, list):  # all prices of the shard are here
                    codes, logp = np.array(codes, np.uint64), np.array(logp, np.float64)
                cells.append((chunk, s, pack(logp[np.searchsorted(codes, unsteps(blob))])))
            if cells:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), [pa.int64(), pa.int64(), pa.binary()])], ["chunk", "shard", "logp"])

    none = lambda t: F.lit(None).cast(t)
    prices = priced.select("shard", F.lit(0).alias("kind"), "code", "logp", none("bigint").alias("chunk"), none("binary").alias("codes"))
    asked = packed.select("shard", F.lit(1).alias("kind"), none("bigint").alias("code"), none("double").alias("logp"), "chunk", "codes")
    dealt = prices.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "code")
    return dealt.mapInArrow(work, "chunk bigint, shard bigint, logp binary")


def scored(parts: DataFrame, prices: DataFrame, shards: int, id_type: str) -> DataFrame:
    """(doc_id, h, lang, n_tokens, nll, held) per row, from chunks and their prices."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {s: unpack(p, "<f8") for s, p in zip(right.column("shard").to_pylist(), right.column("logp").to_pylist())}
        out = []
        for row in left.to_pylist():
            lengths, data = np.asarray(row["lengths"], np.int64), _text_of(row["data"])
            codes, _ = distinct_grams(data, lengths, np.zeros(len(lengths), np.int64))
            order, _, shard = by_shard(codes, shards)
            logp = np.zeros(len(codes))
            if len(codes):
                logp[order] = np.concatenate([found[s] for s in shard.tolist()])
            nll = np.zeros(len(lengths))
            for some, doc, times in runs(data, lengths):
                nll -= np.bincount(doc, weights=times * logp[np.searchsorted(codes, some)], minlength=len(lengths))
            held = set(row["held"] or [])
            out.append(pa.table({
                "doc_id": pa.array([k["id"] for k in row["keys"]], kind(left)), "h": pa.array([k["h"] for k in row["keys"]], pa.int64()),
                "lang": pa.array(row["langs"], pa.string()), "n_tokens": pa.array(lengths), "nll": pa.array(nll),
                "held": pa.array([i in held for i in range(len(lengths))])}))
        return pa.concat_tables(out) if out else empty(left)

    def kind(left):
        return left.schema.field("keys").type.value_type.field("id").type

    def empty(left):
        return pa.table({"doc_id": pa.array([], kind(left)), "h": pa.array([], pa.int64()), "lang": pa.array([], pa.string()),
                         "n_tokens": pa.array([], pa.int64()), "nll": pa.array([], pa.float64()), "held": pa.array([], pa.bool_())})

    schema = f"doc_id {id_type}, h bigint, lang string, n_tokens bigint, nll double, held boolean"
    return parts.groupBy("chunk").cogroup(prices.groupBy("chunk")).applyInArrow(work, schema)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, h, lang, n_tokens, perplexity, threshold, kept) per input row; h is the text's hash.

    ``labels`` (doc_id, quality, toxic) names the trusted documents: quality 1, toxic not 1; a
    label without an id names none.  A language's threshold is the ``quantile`` of its held-out
    documents' perplexity; languages (or rows without one) with under ``LEAST_TRUSTED`` of them take
    that of all.  ``n_tokens`` counts bytes without the white space around the text.  Texts without
    words (null, empty) have no perplexity and are not kept; without any held-out document every
    text with words is kept.  Repeated rows count each time; other columns are not read; an empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "perplexity")
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain, name, path = scratch.table(chunks(docs, doc_id, text, lang), "chunk", max(least, docs.rdd.getNumPartitions()))
    shards = min(SHARDS, max(least, plain.count() // 4))
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) != 1").select(F.col("doc_id").alias("__id")).distinct()
    where = plain.select("chunk", F.posexplode("keys").alias("pos", "key")).join(good, F.col("key.id") == F.col("__id"))
    out = F.pmod(F.xxhash64(F.lit(5), "__id"), F.lit(HELD_OUT)) == 0
    trusted, _ = scratch.pin(where.groupBy("chunk").agg(F.collect_list(F.when(~out, F.col("pos"))).alias("trusted"),
                                                        F.collect_list(F.when(out, F.col("pos"))).alias("held")))
    parts = plain.join(trusted, "chunk", "left")
    packed, packed_path = scratch.pin(chunk_grams(parts, shards))
    counted, _ = scratch.pin(shard_counts(packed, shards))
    prices = chunk_prices(packed, log_probabilities(counted), shards)
    rows, _ = scratch.pin(scored(parts, prices, shards, docs.schema[doc_id].dataType.simpleString()))
    scratch.drop(packed_path)
    scratch.drop_table(name, path)
    rows = rows.withColumn("perplexity", F.when(F.col("n_tokens") > 0, F.exp(F.col("nll") / F.col("n_tokens"))))
    own = rows.filter("held AND n_tokens > 0")
    cut = F.percentile_approx("perplexity", quantile, 10_000)
    common = own.agg(cut).first()[0]
    by_lang = own.groupBy("lang").agg(cut.alias("threshold"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_TRUSTED)
    limits = by_lang.select(F.col("lang").alias("__lang"), "threshold")
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    limit = F.coalesce("threshold", F.lit(common).cast("double"), F.lit(float("inf")))
    return joined.select("doc_id", "h", "lang", "n_tokens", "perplexity", limit.alias("threshold"),
                         F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("kept"))


def kept(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, all columns as they are."""
    good = classify(docs, labels, doc_id, text, lang).filter("kept").select(
        F.col("doc_id").alias("__i"), F.col("h").alias("__x"), F.col("lang").alias("__l")).distinct()
    return docs.join(good, F.col(doc_id).eqNullSafe(F.col("__i")) & (F.xxhash64(F.col(text)) == F.col("__x"))
                     & F.col(lang).eqNullSafe(F.col("__l")), "left_semi")
