"""Query-aware ranking, vector search, chunking and session expiry."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import barrier, best
from ..functions.scores import dot, keyword_matches, relevance
from ..functions.text import query_keywords


def latest_user_turn(turns: DataFrame) -> DataFrame:
    """conv_id, turn, text of the last user turn: an aggregate, so a long conversation is reduced before the shuffle."""
    u = turns.where("role = 'user'")
    return u.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("m")).select("conv_id", "m.turn", "m.text")


def conversation_keywords(turns: DataFrame, limit: int = 12) -> DataFrame:
    return latest_user_turn(turns).withColumn("keywords", query_keywords("text", limit))


def rank_units(units: DataFrame, keywords: Column, limit: int = 14) -> DataFrame:
    """Adds matched_keywords, relevance and rank within each document. units: phrase, words, evidence_sentence, unit_importance, evidence_score, role."""
    u = barrier(units, __text=F.lower(F.concat_ws(" ", "phrase", "words", "evidence_sentence")), __kw=keywords)
    u = barrier(u, matched_keywords=keyword_matches(F.col("__text"), F.col("__kw")))
    share = F.size("matched_keywords") / F.greatest(F.size("__kw"), F.lit(1))
    u = u.withColumn("relevance", relevance(share, F.coalesce("unit_importance", F.lit(0.0)), F.coalesce("evidence_score", F.lit(0.0)), F.coalesce("role", F.lit(""))))
    return best(u, ["doc_id"], [F.desc("relevance"), F.col("sentence_index"), F.col("phrase")], "rank", limit).drop("__text", "__kw")


def row_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added up in the order of the elements as dot() does."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def block_topk(query_ids: np.ndarray, q: np.ndarray, k: int, chunk: int = 500) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function over batches of vectors that gives the best k of them for each query of a block.

    A matrix product finds the vectors that may be among them, with a margin over its rounding; those are scored as dot() does.
    """
    q_norm = np.sqrt(row_dots(q, q))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, scores = np.zeros(0, int), None, np.zeros(0)
        least = np.full(len(q), -np.inf)
        for batch in batches:
            for start in range(0, len(batch), chunk):
                part = batch.iloc[start : start + chunk]
                v = np.stack(part["embedding"].to_numpy()).astype(float)
                v_norm = np.sqrt(row_dots(v, v))
                about = q @ v.T / np.outer(q_norm, v_norm)
                bound = np.maximum(least, np.partition(about, -k, axis=1)[:, -k]) if len(part) >= k else least
                i, j = np.nonzero(about >= bound[:, None] - 1e-9)
                found = row_dots(q[i], v[j]) / (q_norm[i] * v_norm[j])
                new = part["vec_id"].to_numpy()[j]
                at, ids, scores = np.r_[at, i], new if ids is None else np.r_[ids, new], np.r_[scores, found]
                order = np.lexsort((ids, -scores, at))
                at, ids, scores = at[order], ids[order], scores[order]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                at, ids, scores, place = (x[place < k] for x in (at, ids, scores, place))
                least[at[place == k - 1]] = scores[place == k - 1]
        if len(at):
            yield pd.DataFrame({"query_id": query_ids[at], "vec_id": ids, "score": scores})

    return run


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, max_queries: int = 4000) -> DataFrame:
    """query_id, vec_id, score, rank: for each query the most similar vectors.

    vectors: vec_id, embedding; queries: query_id, q. Queries of a block, about ``max_queries``, meet all vectors in matrix
    products; each task keeps its best k before the shuffle. All pairs are scored, so time grows with the
    product of both counts, memory with a block alone. Zero vectors are left out.
    """
    v = vectors.withColumn("v_norm", F.sqrt(dot(F.col("embedding"), F.col("embedding")))).where("v_norm > 0")
    q = queries.withColumn("q_norm", F.sqrt(dot(F.col("q"), F.col("q")))).where("q_norm > 0")
    sizes = lambda df, x, norm: df.agg(F.count("*"), F.min(F.size(x)), F.max(F.size(x)), F.max(norm)).first()
    of_q, of_v = sizes(q, "q", "q_norm"), sizes(v, "embedding", "v_norm")
    n = of_q[0]
    blocks = 1 if n <= max_queries else -(-2 * n // max_queries)
    numeric = all(dict(df.dtypes)[c] in ("tinyint", "smallint", "int", "bigint") for df, c in ((vectors, "vec_id"), (queries, "query_id")))
    # vectors of one length with finite norms make matrices
    plain = n and of_v[0] and numeric and {*of_q[1:3]} == {*of_v[1:3]} and len({*of_q[1:3]}) == 1 and max(of_q[3], of_v[3]) < 1e150

    def block(i: int) -> DataFrame:
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        if plain:
            rows = part.select("query_id", "q").toPandas()
            run = block_topk(rows["query_id"].to_numpy(), np.array(rows["q"].tolist(), float).reshape(len(rows), of_q[1]), k)
            ids = f"query_id {dict(queries.dtypes)['query_id']}, vec_id {dict(vectors.dtypes)['vec_id']}, score double"
            s = v.select("vec_id", "embedding").mapInPandas(run, ids)
        else:
            s = v.join(F.broadcast(part), F.lit(True)).select("query_id", "vec_id", (dot(F.col("q"), F.col("embedding")) / (F.col("q_norm") * F.col("v_norm"))).alias("score"))
        return best(s, ["query_id"], [F.desc("score"), F.col("vec_id")], "rank", k)

    return reduce(DataFrame.unionByName, map(block, range(blocks)))


def char_chunks(text: str | None, size: int = 800, overlap: int = 100, reach: int = 150, least: int = 20) -> list[str]:
    """Pieces of ``size`` characters, each to the next full stop if it is within reach, overlapping."""
    text = (text or "").strip()
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        stop = text.find(".", end) if end < len(text) else -1
        if 0 < stop - end < reach:
            end = stop + 1
        piece = text[start:end].strip()
        if len(piece) > least:
            out.append(piece)
        start = end - overlap if end - overlap > start else start + size
    return out


def chunk_documents(docs: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """doc_id, chunk_id, text. Where a piece starts depends on the one before, so this is a function over whole texts."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: char_chunks(t, size, overlap))

    return docs.select("doc_id", F.posexplode(run("text")).alias("k", "text")).select("doc_id", F.concat(F.lit("chunk_"), "k").alias("chunk_id"), "text")


def active_sessions(events: DataFrame, now: Column, ttl_seconds: int = 3600, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """key, last_seen of sessions that have not expired by now."""
    last = events.groupBy(key).agg(F.max(ts).alias("last_seen"))
    return last.where(F.unix_timestamp(now) - F.unix_timestamp("last_seen") <= ttl_seconds)
