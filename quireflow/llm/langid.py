"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text accepts every substring of it. A text is parsed from left to
right into longest matches; c phrases over m symbols against n symbols of labelled text give c * log2(n) / m bits
a symbol, and the language of the fewest wins. As a parse restarts at the automaton's root after each phrase, the
automaton turns into a table that also counts phrases, so that many blocks of text step through it at once; a parse
restarts every ``block`` symbols, which cuts at most one phrase of a block, in all languages alike.

The automata are fitted on a bounded sample: of each language about ``docs_per_lang`` labelled documents, those
with the lowest hashes of doc_id among those of at most ``doc_chars`` characters (the shortest one if there is none),
each whole, until they have ``total_chars`` divided by the number of languages. All of a sample's letters are symbols, whatever
the alphabet. Prediction covers whole texts of all rows, in one pass without a shuffle.

Edge cases: a text that is null or has no letter is ``und`` with score 0; a null language is never learned; with
nothing to learn from every text is ``und``; very long texts are parsed whole; a null doc_id isn't held out and is never learned from; repeated rows
are judged one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

SPACE, UNKNOWN = 0, 1


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string")) % n


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton whose paths from state 0 are the substrings."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


class PhraseTable:
    """Steps of a parse through an automaton: from state and symbol to the next state and the phrases that end.

    A step is an entry of a full table, or found among the sorted transitions where a full table would be large.
    """

    def __init__(self, nxt: list[dict[int, int]], width: int, full_entries: int = 4_000_000):
        self.width, n = width, len(nxt)
        rows = np.fromiter((s for s, d in enumerate(nxt) for _ in d), dtype=np.int64)
        cols = np.fromiter((c for d in nxt for c in d), dtype=np.int64)
        to = np.fromiter((t for d in nxt for t in d.values()), dtype=np.int64)
        order = np.argsort(rows * width + cols)
        self.keys, self.to = (rows * width + cols)[order], to[order]
        root = np.full(width, -1, dtype=np.int64)
        root[cols[rows == 0]] = to[rows == 0]
        # where no transition goes on, a phrase ends and the symbol starts the next, or is one of its own if it is unknown
        self.again, self.ends = np.where(root >= 0, root, 0), np.where(root >= 0, 1, 2)
        self.again[width - 1], self.ends[width - 1] = 0, 1  # the last symbol ends a text
        self.full = None
        if n * width <= full_entries:
            state, symbol = np.divmod(np.arange(n * width), width)
            found, ended = self.find(state, symbol)
            self.full = (found * 4 + ended).astype(np.int64)

    def find(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = state * self.width + symbol
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), dtype=bool)
        to = self.to[at] if len(self.keys) else key
        # at the root no phrase is open, so none ends
        return np.where(hit, to, self.again[symbol]), np.where(hit, 0, self.ends[symbol] - (state == 0))

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.full is None:
            return self.find(state, symbol)
        x = self.full[state * self.width + symbol]
        return x >> 2, x & 3


class Model:
    """Tables of all languages; symbols are those of all samples, and each table has its own language's."""

    def __init__(self, texts: dict[str, str], block: int = 4096):
        self.langs, self.block = sorted(texts), block
        letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
        seen = sorted({c for t in texts.values() for c in t.lower() if c.isalpha()})
        self.end = 2 + len(seen)
        self.lookup = np.where(letters, UNKNOWN, SPACE).astype(np.min_scalar_type(self.end))
        self.lookup[[ord(c) for c in seen]] = np.arange(2, self.end)
        self.tables, self.local, self.bits = {}, {}, {}
        for x in self.langs:
            trained = self.symbols(texts[x])
            own = np.unique(trained[trained > UNKNOWN])
            local = np.full(self.end + 1, UNKNOWN, dtype=np.int64)
            local[own], local[SPACE], local[self.end] = np.arange(2, 2 + len(own)), SPACE, 2 + len(own)
            self.local[x] = local
            self.tables[x] = PhraseTable(suffix_automaton(local[trained[trained != UNKNOWN]].tolist()), 3 + len(own))
            self.bits[x] = np.log2(max(2, len(trained)))

    def symbols(self, text: str) -> np.ndarray:
        s = self.lookup[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        return s[(s != SPACE) | (np.append(UNKNOWN, s[:-1]) != SPACE)] if s.size else s

    def phrases(self, docs: list[np.ndarray]) -> np.ndarray:
        """Phrases of each document (rows) in each language (columns)."""
        sizes = np.array([len(d) for d in docs])
        blocks = -(-sizes // self.block)
        grid = np.full((int(blocks.sum()), min(self.block, int(sizes.max())) + 1), self.end, dtype=self.lookup.dtype)
        at = 0
        for d, k in zip(docs, blocks.tolist()):
            whole = len(d) // self.block
            if whole:
                grid[at : at + whole, : self.block] = d[: whole * self.block].reshape(-1, self.block)
            if k > whole:
                grid[at + whole, : len(d) - whole * self.block] = d[whole * self.block :]
            at += k
        owner = np.repeat(np.arange(len(docs)), blocks)
        out = np.zeros((len(docs), len(self.langs)), dtype=np.int64)
        columns = np.ascontiguousarray(grid.T)
        for j, lang in enumerate(self.langs):
            table, local, state, count = self.tables[lang], self.local[lang], np.zeros(len(grid), dtype=np.int64), np.zeros(len(grid), dtype=np.int64)
            for c in columns:
                state, ended = table.step(state, local[c])
                count += ended
            out[:, j] = np.bincount(owner, weights=count, minlength=len(docs))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        held: list[tuple[int, np.ndarray]] = []

        def judge() -> None:
            if not held or not self.langs:
                held.clear()
                return
            rate = self.phrases([d for _, d in held]) * np.array([self.bits[x] for x in self.langs]) / np.array([[len(d)] for _, d in held])
            order = np.argsort(rate, axis=1, kind="stable")
            for (k, _), r, o in zip(held, rate, order):
                langs[k] = self.langs[o[0]]
                scores[k] = float(r[o[1]] / (r[o[0]] + r[o[1]])) if len(o) > 1 and r[o[0]] + r[o[1]] > 0 else 1.0
            held.clear()

        size = 0
        for k, text in enumerate(texts):
            d = self.symbols(text or "")
            if (d != SPACE).any():
                held.append((k, d))
                size += len(d)
                if size > 4_000_000:
                    judge()
                    size = 0
        judge()
        return langs, scores


def training_texts(docs: DataFrame, learn: Column, text_col: str, lang_col: str, id_col: str, docs_per_lang: int, doc_chars: int, total_chars: int) -> dict[str, str]:
    """The bounded sample, as one text for each language."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("text"))
    short = F.length("text") <= doc_chars
    counts = rows.groupBy("lang").agg(F.count_if(short).alias("n")).collect()
    if not counts:
        return {}
    # hashes are even, so a bound on them lets about docs_per_lang rows through, wherever they are
    bounds = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], (1 << 63) - 1 if r["n"] <= docs_per_lang else int(docs_per_lang / r["n"] * (1 << 64)) - (1 << 63))])
    sample = [tuple(r) for r in rows.where(short & (F.col("h") <= F.element_at(bounds, F.col("lang")))).select("lang", "h", "text").distinct().collect()]
    missing = {r["lang"] for r in counts} - {x[0] for x in sample}
    if missing:
        first = rows.where(F.col("lang").isin(*missing)).groupBy("lang").agg(F.min(F.struct(F.length("text").alias("n"), "h", "text")).alias("r"))
        sample += [tuple(r) for r in first.select("lang", "r.h", "r.text").collect()]
    out: dict[str, str] = {}
    for lang, _, text in sorted(sample):
        if len(out.get(lang, "")) < total_chars / len(counts):
            out[lang] = f"{out.get(lang, '')} {text}"
    return out


def identify_languages(
    docs: DataFrame,
    learn: Column | None = None,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    docs_per_lang: int = 64,
    doc_chars: int = 8_000,
    total_chars: int = 160_000,
) -> DataFrame:
    """doc_id, lang_pred, score. learn: which rows may be learned from (all by default)."""
    texts = training_texts(docs, F.lit(True) if learn is None else learn, text_col, lang_col, id_col, docs_per_lang, doc_chars, total_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, key = worker_cache(), ("langid", hash(tuple(sorted(texts.items()))))
        if key not in store:
            store[key] = Model(texts)
        for batch in batches:
            langs, scores = store[key].predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
