"""Cost-balanced packing of documents into fixed-length training sequences.

Each document is tokenised and ends with an end id. Whole sequences are cut from documents of at least
``max_tokens`` ids; the remainders go, longest first, each to the sequence of lowest estimated attention cost
(linear plus quadratic in the piece's length) that still has room. As many sequences are opened as the ids fill,
so what fits nowhere in one piece is cut; what is left over moves to the next block, and the last block of a
partition closes with sequences at powers of two, which need no padding.

Packing runs within a partition, in blocks of a bounded number of ids: there is no shuffle, memory does not
grow with the input, and a lost task is repeated from its own rows alone.

Edge cases: a null or empty text is one end id; repeated rows are packed once for each row; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_ranks(tokenizer_json: dict) -> dict[bytes, int]:
    """The ranks of a byte-level BPE vocabulary: its printable stand-ins turned back into bytes."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    back = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {x["content"] for x in tokenizer_json["added_tokens"]}
    return {bytes(back[c] for c in w): i for w, i in tokenizer_json["model"]["vocab"].items() if w not in special}


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library.

    Latin text without special strings goes through a faster BPE core that is built from the same file; all
    other text goes through the library itself, as Unicode tables of the two might differ there.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = functools.cache(lambda: Tokenizer.from_file(path))  # loaded when a text needs it
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        plain = spec["model"]["type"] == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
        specials = [re.escape(x["content"]) for x in spec["added_tokens"]]
        self.odd = re.compile("|".join(["[^\\x00-\\u024f\\u2010-\\u2027]", *specials]))
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_ranks(spec), special_tokens={}) if plain else None

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not self.odd.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.library().encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def fill(items: list[tuple], capacities: list[int], linear: float, quadratic: float) -> tuple[list[list[tuple]], list[tuple]]:
    """Items (key, ids, start, length) by descending length into bins; cut only where no bin has room for all of it.

    Returns each bin's items in order and what no bin had room for.
    """
    room = np.array(capacities, dtype=np.int64)
    cost = np.zeros(len(room))
    bins: list[list[tuple]] = [[] for _ in capacities]
    over: list[tuple] = []
    for key, ids, start, length in sorted(items, key=lambda x: -x[3]):
        while length:
            fits = room >= length
            if not fits.any():
                fits = room > 0
                if not fits.any():
                    over.append((key, ids, start, length))
                    break
            k = int(np.where(fits, cost, np.inf).argmin())
            n = min(length, int(room[k]))
            bins[k].append((key, ids, start, n))
            room[k] -= n
            cost[k] += linear * n + quadratic * n * n
            start, length = start + n, length - n
    return bins, over


def pack_block(docs: list[tuple], carried: list[tuple], last: bool, max_tokens: int, linear: float, quadratic: float) -> tuple[list[list[tuple]], list[tuple]]:
    """docs: (key, ids). Full sequences and, if last, sequences at powers of two; else the rest is carried on."""
    bins, items = [], list(carried)
    for key, ids in docs:
        whole = len(ids) // max_tokens * max_tokens
        bins += [[(key, ids, k, max_tokens)] for k in range(0, whole, max_tokens)]
        if whole < len(ids):
            items.append((key, ids, whole, len(ids) - whole))
    total = sum(x[3] for x in items)
    sizes = [max_tokens] * (total // max_tokens)
    if last:
        sizes += [1 << b for b in range(max_tokens.bit_length(), -1, -1) if (total % max_tokens) >> b & 1]
    more, over = fill(items, sizes, linear, quadratic)
    return bins + more, over


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    text_col: str = "text",
    id_col: str = "doc_id",
    max_tokens: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1 / 1024,
    block_tokens: int = 2_000_000,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32)."""
    path = tokenizer or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, next_id = Encoder(path), TaskContext.get().partitionId() << 33
        block: list[tuple] = []
        held, carried = 0, []

        def close(last: bool) -> pa.RecordBatch:
            nonlocal next_id, carried, block, held
            bins, carried = pack_block(block, carried, last, max_tokens, linear, quadratic)
            # what is carried must not keep whole documents in memory
            carried = [(key, (ids.size if not isinstance(ids, tuple) else ids[0], ids[start : start + n].copy() if not isinstance(ids, tuple) else ids[1][start - ids[2] : start - ids[2] + n], start), start, n) for key, ids, start, n in carried]
            out: list[list] = [[] for _ in range(7)]
            for pieces in bins:
                at = 0
                for key, ids, start, n in pieces:
                    size, part = (ids.size, ids[start : start + n]) if not isinstance(ids, tuple) else (ids[0], ids[1][start - ids[2] : start - ids[2] + n])
                    for column, value in zip(out, (key, start, n, size, next_id, at, part.astype("<u4").tobytes())):
                        column.append(value)
                    at += n
                next_id += 1
            block, held = [], 0
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:6]), pa.array(out[6], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                block.append((key, ids))
                held += ids.size
                if held >= block_tokens:
                    yield close(False)
        yield close(True)
        del encode  # a worker that lives on keeps no vocabulary
        trim()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
