"""BPE encoding and decoding through a table of distinct words.

A text is split at ASCII white space.  Under a file that lower-cases and splits words by
itself (`bpe_words.WordEncoder.by_word`) no token crosses that white space, so the ids of a
text are those of its words, one after the other:

1. Tasks split the texts of a chunk (CHUNK_BYTES, or one longer text) into words and number
   the distinct ones.  The chunk keeps, packed, the number of the word at each position; its
   distinct words go, each once, to the buckets of a hash.
2. A bucket holds a part of the corpus's distinct-word table: it unites the words that all
   chunks have asked for, encodes each of them once, and answers every chunk.
3. The chunk joins the answers to its positions by word number.

Positions never move: one shuffle has the packed positions and the distinct words (read twice,
made once), a second one the answers.  A very common word is one request from each chunk.  If a
chunk is made again after a lost executor and comes out otherwise than the one answered, its mark
differs and the task fails instead of joining wrong ids.  Under any other file whole texts go to
the library, row by row.  Decoding joins ids to a table of pieces by id.

Defined results: a null or blank text has no ids and decodes to the empty string; null ids
decode to the empty string; ids that the vocabulary lacks are skipped, as the library does;
repeated rows stay; an empty table gives an empty table; columns of the input named like the
output column are replaced, all others are kept whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltflow.llm import storage
from siltflow.llm.bpe_words import encoder
from siltflow.llm.textarrays import release, span_hashes, text_bytes, text_slices
from siltflow.llm.textarrays import rolling as rolling_codes

#: Bytes of text in a chunk, and ids decoded at once.
CHUNK_BYTES = 8 << 20
SLICE_IDS = 1 << 20
#: A hash of words is taken over so many bytes at once.
HASH_BYTES = 1 << 20

_DEALT = "key long, chunk long, mark long, payload binary, more binary, buckets binary"
_NOTHING = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("mark", pa.int64()), ("payload", pa.binary()), ("more", pa.binary()), ("buckets", pa.binary())])


def _zip(array: np.ndarray | bytes) -> bytes:
    raw = array if isinstance(array, bytes) else np.ascontiguousarray(array).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unzip(raw: bytes, kind: str = "u1") -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True), kind)


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32 as planes of bytes, as many as the largest needs."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + _zip(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T)


def _from_planes(raw: bytes) -> np.ndarray:
    width, flat = raw[0], _unzip(raw[1:])
    out = np.zeros((len(flat) // width, 4), np.uint8)
    out[:, :width] = flat.reshape(width, -1).T
    return out.view("<u4").reshape(-1)


def _distinct(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, the number of the word at each position, and how many positions each text has."""
    if texts.null_count:
        texts = texts.fill_null("")
    lists = pc.ascii_split_whitespace(texts)
    ends = np.asarray(lists.offsets).astype(np.int64)
    words = lists.flatten()
    solid = pc.not_equal(words, "")
    sizes = np.diff(ends)
    if not pc.all(solid, min_count=0).as_py():
        keep = solid.to_numpy(zero_copy_only=False)
        upto = np.concatenate(([0], np.cumsum(keep)))
        sizes = np.diff(upto[ends - ends[0]])
        words = words.filter(solid)
    held = words.dictionary_encode()
    return held.dictionary, np.asarray(held.indices), sizes


def _buckets(words: pa.Array, buckets: int) -> np.ndarray:
    out = []
    for a, b in text_slices(words, HASH_BYTES):
        raw, ends = text_bytes(words.slice(a, b - a))
        out.append(span_hashes(rolling_codes(raw), ends[:-1], ends[1:]) % np.uint64(buckets))
    return np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)


def _spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each length, one after the other."""
    upto = np.cumsum(lengths)
    source = np.repeat(begins - (upto - lengths), lengths)
    source += np.arange(len(source), dtype=source.dtype)
    return source


def encode_column(texts: pa.Array, path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of the texts in turn: all ids, and where each text's ids begin, with the end; each distinct word of a slice is encoded once."""
    coder = encoder(path)
    if texts.null_count:
        texts = texts.fill_null("")
    for a, b in text_slices(texts, CHUNK_BYTES):
        own = texts.slice(a, b - a)
        if coder.by_word:
            words, at, sizes = _distinct(own)
            ids, n = coder.words(words)
            lengths = n[at]
            upto = np.concatenate(([0], np.cumsum(lengths)))
            yield ids[_spread((np.cumsum(n) - n)[at], lengths)], upto[np.concatenate(([0], np.cumsum(sizes)))]
            del words, at, ids, n, lengths, upto
        else:
            ids, n = coder.texts(own.to_pylist())
            yield ids, np.concatenate(([0], np.cumsum(n)))
        release()


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of CHUNK_BYTES of text together at most, or one row; the text is the first column."""
    held, size = [], 0
    for batch in batches:
        texts = batch.column(0)
        if texts.null_count:
            texts = texts.fill_null("")
        batch = pa.RecordBatch.from_arrays([texts, *batch.columns[1:]], [f"c{k}" for k in range(batch.num_columns)])
        for a, b in text_slices(texts, CHUNK_BYTES):
            own = batch.slice(a, b - a)
            n = pc.sum(pc.binary_length(own.column(0))).as_py() or 0
            if held and size + n > CHUNK_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(own)
            size += n
    if held:
        yield pa.Table.from_batches(held)


def _dealer(buckets: int):
    """Rows (text, others) to a row for each chunk and one for each bucket that it asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for table in chunks(batches):
            words, at, sizes = _distinct(table.column(0).combine_chunks())
            raw, _ = text_bytes(words)
            mark = zlib.crc32(raw)
            bucket = _buckets(words, buckets)
            order = np.argsort(bucket, kind="stable")
            sorted_words, cuts = words.take(pa.array(order)), np.searchsorted(bucket[order], np.arange(buckets + 1))
            others = table.drop_columns(["c0"]).append_column("n", pa.array(sizes)).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, others.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(others)
            rows = [(number, number, mark, sink.getvalue().to_pybytes(), _planes(at), _planes(bucket))]
            for k in range(buckets):
                a, b = int(cuts[k]), int(cuts[k + 1])
                if b > a:
                    data, ends = text_bytes(sorted_words.slice(a, b - a))
                    rows.append((-1 - k, number, mark, _zip(data), _planes(np.diff(ends)), None))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _NOTHING, strict=True)], schema=_NOTHING)
            number += 1
            del table, words, at, sizes, raw, bucket, order, sorted_words, others, rows
            release()

    return run


def _answerer(path: str):
    """The rows of buckets to answers: key (the chunk), bucket, mark, ids and how many each word has, in the order asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        asked: dict[int, list[tuple[int, int, bytes, bytes]]] = {}
        for batch in batches:
            some = batch.filter(pc.less(batch.column(0), 0))
            for key, chunk, mark, payload, more in zip(*(some.column(k).to_pylist() for k in range(5)), strict=True):
                asked.setdefault(-1 - key, []).append((chunk, mark, payload, more))
        for bucket in list(asked):
            parts = asked.pop(bucket)
            lots = []
            for _, _, payload, more in parts:
                ends = np.concatenate(([0], np.cumsum(_from_planes(more))))
                lots.append(pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(_unzip(payload))))
            held = pa.concat_arrays(lots).dictionary_encode()
            counts = [len(x) for x in lots]
            del lots
            ids, n = coder.words(held.dictionary.cast(pa.string()))
            begins, at, first = np.cumsum(n) - n, np.asarray(held.indices), 0
            for (chunk, mark, _, _), count in zip(parts, counts, strict=True):
                own = at[first : first + count]
                first += count
                answer = _planes(ids[_spread(begins[own], n[own])])
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([bucket], pa.int32()), pa.array([mark]), pa.array([answer], pa.binary()), pa.array([_planes(n[own])], pa.binary())], ["key", "bucket", "mark", "ids", "sizes"])
            release()

    return run


def _joiner(places: list[int | None], schema: pa.Schema):
    """Chunk rows and their answers to the rows of the texts; places: where each output column stands in the payload, None for the ids."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or left["key"][0].as_py() < 0:
            return schema.empty_table()
        if left.num_rows != 1:
            raise RuntimeError("two chunks have one number")
        mark, payload, more, which = (left[k][0].as_py() for k in ("mark", "payload", "more", "buckets"))
        others, at, bucket = pa.ipc.open_stream(payload).read_all(), _from_planes(more).astype(np.int64), _from_planes(which)
        answers = sorted(zip(right["bucket"].to_pylist(), right["mark"].to_pylist(), right["ids"].to_pylist(), right["sizes"].to_pylist(), strict=True))
        n = np.concatenate([_from_planes(x[3]) for x in answers]).astype(np.int64) if answers else np.zeros(0, np.int64)
        ids = np.concatenate([_from_planes(x[2]) for x in answers]).astype(np.int32) if answers else np.zeros(0, np.int32)
        if len(n) != len(bucket) or any(x[1] != mark for x in answers):
            raise RuntimeError("a chunk was made again with other rows than those answered")
        # answers follow the buckets; position -> word -> place among the answers -> ids
        rank = np.empty(len(bucket), np.int64)
        rank[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
        at = rank[at]
        lengths = n[at]
        upto = np.concatenate(([0], np.cumsum(lengths)))
        ends = upto[np.concatenate(([0], np.cumsum(others["n"].to_numpy())))]
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids[_spread((np.cumsum(n) - n)[at], lengths)]))
        out = pa.Table.from_arrays([lists if k is None else others.column(k) for k in places], names=schema.names)
        release()
        return out

    return run


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """Add the ids of each text, array<int>, as the library's encode(text, add_special_tokens=False) gives them.

    keep_text=False leaves the text column out, so that it takes no part in the shuffle.
    """
    if not encoder(path).by_word:

        def whole(texts: pa.Array) -> pa.Array:
            parts = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32())) for values, ends in encode_column(texts, path)]
            return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

        coded = df.withColumn(ids, F.arrow_udf(whole, "array<int>")(F.col(text)))
        return coded if keep_text else coded.drop(text)
    from pyspark.sql.pandas.types import to_arrow_schema

    buckets = storage.partitions(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != ids and (keep_text or f.name != text)]
    wanted = [f for f in df.schema.fields if keep_text or f.name != text or f.name == ids]
    added = T.StructField(ids, T.ArrayType(T.IntegerType()))
    fields = [added if f.name == ids else f for f in wanted] + [added] * all(f.name != ids for f in wanted)
    names = [f.name for f in kept]
    places = [None if f.name == ids else names.index(f.name) for f in fields]
    rows = df.select(F.col(text).alias("c0"), *[F.col(f"`{f.name.replace('`', '``')}`").alias(f"c{k + 1}") for k, f in enumerate(kept)])
    dealt = rows.mapInArrow(_dealer(buckets), _DEALT).repartition(buckets, "key")
    told = dealt.mapInArrow(_answerer(path), "key long, bucket int, mark long, ids binary, sizes binary").repartition(buckets, "key")
    out = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)])
    joined = dealt.groupBy("key").cogroup(told.groupBy("key")).applyInArrow(_joiner(places, to_arrow_schema(out)), out)
    return joined.toDF(*[f.name for f in fields])


def _pieces(path: str) -> pa.Array:
    """The table of pieces: the piece of id k stands at place k."""
    if path not in _tables:
        coder = encoder(path)
        _tables[path] = pa.array([coder.whole.id_to_token(k) for k in range(coder.size)], pa.string())
    return _tables[path]


_tables: dict[str, pa.Array] = {}


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of each list of ids, as the library's decode(ids, skip_special_tokens=False) gives it."""

    def run(lists: pa.Array) -> pa.Array:
        if encoder(path).whole.decoder is not None:
            return pa.array([encoder(path).whole.decode([k for k in x or [] if k is not None and 0 <= k < 1 << 32], skip_special_tokens=False) for x in lists.to_pylist()], pa.string())
        # without decoder: the pieces with a space between
        pieces = _pieces(path)
        if lists.null_count:
            lists = pa.array([x or [] for x in lists.to_pylist()], lists.type)
        out, all_ends, row = [], np.asarray(lists.offsets).astype(np.int64), 0
        while row < len(lists):
            stop = max(row + 1, int(np.searchsorted(all_ends, all_ends[row] + SLICE_IDS, side="right")) - 1)
            own = lists.slice(row, stop - row)
            row, flat, ends = stop, own.flatten(), np.asarray(own.offsets)
            known = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces))), False)
            if not pc.all(known, min_count=0).as_py():
                keep = np.asarray(known)
                ends = np.concatenate(([0], np.cumsum(keep)))[ends - ends[0]]
                flat = flat.filter(known)
            ends = (ends - ends[0]).astype(np.int32)
            out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pieces.take(flat)), " "))
        release()
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return df.withColumn(text, F.arrow_udf(run, "string")(F.col(ids)))
