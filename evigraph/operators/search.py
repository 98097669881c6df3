"""Full-text retrieval: a positional inverted index and BM25 over weighted columns, for many queries in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions.scores import bm25_norm, lexical
from evigraph.functions.text import casefold, index_tokens

K1, B, FLOOR = 1.2, 0.75, 1e-6
#: Weights of a chunk's and a node's columns. Fixed values.
CHUNK_WEIGHTS = {"path": 1.8, "symbol": 1.2, "tags": 0.5, "content": 1.0}
NODE_WEIGHTS = {"name": 2.0, "qualified_name": 1.5, "path": 0.8, "kind": 0.4, "metadata": 0.2}


def postings(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(doc, col, pos, tok): each word of each column. Written sorted by tok, it is the index."""
    arrays = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), index_tokens(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("toks")) for c in columns]))
    return docs.select(F.col(key).alias("doc"), arrays.alias("f")).select("doc", F.col("f.col").alias("col"), F.posexplode("f.toks").alias("pos", "tok"))


def lengths(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(doc, dl, digest): the words of all columns, and a hash of what they hold."""
    total, texts = F.lit(0), [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    for t in texts:
        total = total + F.size(index_tokens(t))
    return docs.select(F.col(key).alias("doc"), total.alias("dl"), F.xxhash64(*texts).alias("digest"))


def write_index(docs: DataFrame, key: str, columns: list[str], path: str, parts: int = 64) -> None:
    """Postings below path/postings, dealt and sorted by word so that a query reads few row groups, and lengths below path/lengths."""
    postings(docs, key, columns).repartitionByRange(parts, "tok").sortWithinPartitions("tok", "doc").write.mode("overwrite").parquet(f"{path}/postings")
    lengths(docs, key, columns).write.mode("overwrite").parquet(f"{path}/lengths")


def chunk_docs(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Chunks with the columns that are searched: their symbol's name, and their tags as words."""
    names = nodes.select(F.col("node_id").alias("symbol_id"), F.col("qualified_name").alias("symbol"))
    return chunks.join(names, "symbol_id", "left").withColumn("tags", F.array_join("tags", " "))


def refreshed(docs: DataFrame, key: str, columns: list[str], old: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of docs. Of a document that old has with the same contents the old rows are taken, and its text isn't split."""
    if old is None:
        return postings(docs, key, columns), lengths(docs, key, columns)
    posted, sizes = old
    digest = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    same = docs.select(F.col(key).alias("doc"), digest.alias("digest")).join(sizes, ["doc", "digest"], "left_semi").select("doc")
    new = docs.join(same, F.col(key) == F.col("doc"), "left_anti")
    return tuple(kept.join(same, "doc", "left_semi").unionByName(made(new, key, columns)) for kept, made in ((posted, postings), (sizes, lengths)))


def phrases(queries: DataFrame, most: int = 20) -> DataFrame:
    """queries (query, text) -> (query, phrase, k, tok, size): the words that the index has for each token of the query; a token that it splits is a phrase."""
    raw = F.regexp_extract_all(casefold(F.col("text")), F.lit(r"([\p{L}\p{N}_.\-]+)"), F.lit(1))
    tokens = F.slice(F.array_distinct(F.filter(raw, lambda w: F.length(w) > 1)), 1, most)
    each = queries.select("query", F.posexplode(tokens).alias("phrase", "token")).withColumn("words", index_tokens(F.col("token")))
    return each.select("query", "phrase", F.size("words").alias("size"), F.posexplode("words").alias("k", "tok"))


def expand_prefixes(wanted: DataFrame, posted: DataFrame) -> DataFrame:
    """The last word of each phrase becomes all words of the vocabulary that begin with it."""
    # The first two letters are the key; of the wanted words, which are few, one of a single letter has none, and matches by the first
    last = F.col("k") == F.col("size") - 1
    vocabulary = posted.select("tok").distinct().select(F.col("tok").alias("word"), F.explode(F.array(F.substring("tok", 1, 1), F.substring("tok", 1, 2))).alias("key")).distinct()
    ends = wanted.filter(last).withColumn("key", F.substring("tok", 1, 2))
    grown = vocabulary.join(F.broadcast(ends), "key").filter(F.startswith("word", "tok")).select("query", "phrase", "size", "k", F.col("word").alias("tok")).distinct()
    return wanted.filter(~last).select("query", "phrase", "size", "k", "tok").union(grown)


def bm25(posted: DataFrame, sizes: DataFrame, wanted: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(query, doc, bm25): the sum over phrases of idf and saturated weighted frequency.

    idf = ln((N - n + .5) / (n + .5)), or 1e-6 where that isn't positive; N, and the mean length, over all documents. The query's
    words are few, so they go to the postings, which are read once for all queries."""
    hits = posted.join(F.broadcast(wanted), "tok").select("query", "phrase", "size", "doc", "col", (F.col("pos") - F.col("k")).alias("at"), "k")
    found = hits.groupBy("query", "phrase", "size", "doc", "col", "at").agg(F.count_distinct("k").alias("n")).filter("n = size")
    weight = F.try_element_at(F.create_map(*[x for c, w in weights.items() for x in (F.lit(c), F.lit(float(w)))]), F.col("col"))
    tf = found.groupBy("query", "phrase", "doc").agg(F.sum(F.coalesce(weight, F.lit(0.0))).alias("f"))
    n = tf.groupBy("query", "phrase").agg(F.count("*").alias("n"))
    corpus = sizes.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))
    idf = F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    scored = tf.join(F.broadcast(n), ["query", "phrase"]).join(sizes, "doc").crossJoin(F.broadcast(corpus)).withColumn("idf", F.when(idf > 0, idf).otherwise(F.lit(FLOOR)))
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("query", "doc").agg(F.sum(part).alias("bm25"))


def top(scored: DataFrame, limit: int = 20, digits: int = 6) -> DataFrame:
    """(query, doc, score, rank, lexical): the best `limit` of each query; equal scores go by document."""
    rounded = F.round("bm25", digits)
    ranked = scored.select("query", "doc", rounded.alias("score"), F.row_number().over(W.partitionBy("query").orderBy(F.desc(rounded), "doc")).alias("rank")).filter(F.col("rank") <= limit)
    return ranked.withColumn("lexical", F.round(lexical(F.col("rank"), bm25_norm(F.col("score"))), digits))


def matched(docs: DataFrame, key: str, columns: list[str], wanted: list, prefix: bool) -> DataFrame:
    """(doc, dl, hits): a row for each document, with those of its words, in (col, pos, tok), that a query asks for."""
    exact = sorted({r["tok"] for r in wanted})
    begins = sorted({r["tok"] for r in wanted if r["k"] == r["size"] - 1}) if prefix else []

    def asked(t: Column) -> Column:
        out = t.isin(exact)
        for p in begins:
            out = out | F.startswith(t, F.lit(p))
        return out

    toks = {c: index_tokens(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns}
    whole = docs.select(F.col(key).alias("doc"), *[t.alias(f"t{k}") for k, t in enumerate(toks.values())])

    def found(k: int, c: str) -> Column:
        each = F.transform(f"t{k}", lambda t, i: F.when(asked(t), F.struct(F.lit(c).alias("col"), i.alias("pos"), t.alias("tok"))))
        return F.filter(each, lambda h: h.isNotNull())

    hits = [found(k, c) for k, c in enumerate(columns)]
    total = F.size("t0")
    for k in range(1, len(columns)):
        total = total + F.size(f"t{k}")
    return whole.select("doc", total.alias("dl"), F.concat(*hits).alias("hits"))


def search(docs: DataFrame, key: str, weights: dict[str, float], queries: DataFrame, limit: int = 20, prefix: bool = False) -> DataFrame:
    """The whole retrieval without a stored index. Texts are split once: what the queries ask for, and the lengths, are kept."""
    wanted = phrases(queries)
    few = wanted.select("tok", "k", "size").collect()  # at most 20 tokens a query
    kept = matched(docs, key, list(weights), few, prefix).persist()
    posted = kept.select("doc", F.explode("hits").alias("h")).select("doc", "h.col", "h.pos", "h.tok")
    if prefix:
        wanted = expand_prefixes(wanted, posted)
    return top(bm25(posted, kept.select("doc", "dl"), wanted, weights), limit)


def search_stored(posted: DataFrame, sizes: DataFrame, weights: dict[str, float], queries: DataFrame, limit: int = 20) -> DataFrame:
    """The same from stored postings, sorted by word: the scan gets the words of the queries as a filter, so it reads the row groups that hold them."""
    wanted = phrases(queries)
    few = sorted({r["tok"] for r in wanted.select("tok").collect()})  # at most 20 tokens a query
    return top(bm25(posted.filter(F.col("tok").isin(few)), sizes, wanted, weights), limit)


def node_score(norm: Column) -> Column:
    """What a node that only full text finds is worth."""
    return F.lit(0.6) + F.lit(0.1) * norm
