"""Byte-level BPE: each task encodes its words by a recursive DuckDB query over token positions
and decodes ids by an ordered aggregation. The vocabulary is a file of ranks; none is trained."""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 20  # characters tokenised at a time
QUERY_BYTES = 1 << 18  # of new words in one recursive query
DECODE_TOKENS = 1 << 18
KNOWN_WORDS = 300_000  # encoded words that a task remembers; more words are encoded again
LONG_WORD = 512  # bytes; one round per merge is quadratic, so longer words merge by a heap

# A row per word with its tokens in order. Each round lays the pairs of neighbours out as rows,
# joins them with the merge table and contracts the leftmost pair of least rank of each word;
# words without such a pair are done.
ENCODE = """
with recursive t(w, ids, done) as (
  select w, list(id order by pos), false from start group by w
  union all
  (with pairs as (
     select w, unnest(ids[:-2]) as a, unnest(ids[2:]) as b, unnest(range(1, len(ids))) as i from t where not done and len(ids) > 1),
   best as (select w as bw, min((m::bigint << 20) | i) as low from pairs join merges on k = (a::bigint << 20) | b group by w)
   select w, case when low is null then ids
     else list_concat(ids[:(low & 1048575) - 1], [(low >> 20)::int], ids[(low & 1048575) + 2:]) end, low is null
   from t left join best on w = bw where not done)
)
select w, ids from t where done"""

DECODE = "select d, string_agg(piece, '' order by pos) as text from tokens join pieces using (id) group by d"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> dict[str, np.ndarray]:
    """Every pair of tokens whose bytes together are a token, with the rank of that token."""
    rows = [(a << 20 | b, m) for t, m in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
    k, m = zip(*rows)
    return {"k": np.array(k, np.int64), "m": np.array(m, np.int32)}


class Codec:
    """Encodes and decodes within one task."""

    def __init__(self, ranks: dict[bytes, int], merges: dict[str, np.ndarray], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        self._load("merges", merges)
        ids = np.array(list(ranks.values()), np.int32)
        # Bytes travel as characters from U+0100 on, so a piece of a character is text as well.
        pieces = pa.table({"id": ids, "piece": ["".join(chr(256 + b) for b in t) for t in ranks]})
        self._load("pieces", pieces)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.decimal = {i: str(i) for i in ranks.values()}

    def _load(self, name, data):
        self.con.register("given", pa.table(data) if isinstance(data, dict) else data)
        self.con.execute(f"create or replace table {name} as select * from given")
        self.con.unregister("given")

    def _query(self, words: list[bytes]) -> list[bytes]:
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        pos = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self._load("start", {"w": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "pos": pos.astype(np.int32), "id": self.single[data]})
        out = [b""] * len(words)
        for part in self.con.sql(ENCODE).to_arrow_table().to_batches():
            lists = part.column("ids")
            data = np.asarray(lists.values, np.int32).tobytes()
            ends = (np.asarray(lists.offsets) * 4).tolist()
            for w, a, b in zip(part.column("w").to_pylist(), ends, ends[1:]):
                out[w] = data[a:b]
        return out

    def _heap(self, word: bytes) -> list[int]:
        """The same merges for a long word, in n log n: a heap of pairs by rank, then place."""
        ids, nxt, prev = self.single[np.frombuffer(word, np.uint8)].tolist(), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        parts = [bytes([b]) for b in word]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(word) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if parts[i] is not a or j >= len(word) or parts[j] is not b:
                continue
            parts[i], ids[i], parts[j], nxt[i] = a + b, rank, None, nxt[j]
            if nxt[i] < len(word):
                prev[nxt[i]] = i
            for x, y in ((prev[i], i), (i, nxt[i])):
                if x >= 0 and y < len(word) and (r := self.ranks.get(parts[x] + parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [t for t, p in zip(ids, parts) if p is not None]

    def learn(self, words) -> None:
        """Encode the words that are not known yet."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        todo, size = [], 0
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        for n, w in enumerate(new, 1):
            data = w.encode("utf-8", "replace")
            rank = self.ranks.get(data)
            if rank is not None:
                self.known[w] = rank.to_bytes(4, "little")
            elif len(data) > LONG_WORD:
                self.known[w] = np.array(self._heap(data), "<i4").tobytes()
            else:
                todo.append((w, data))
                size += len(data)
            if todo and (size >= QUERY_BYTES or n == len(new)):
                for (word, _), ids in zip(todo, self._query([d for _, d in todo])):
                    self.known[word] = ids
                todo, size = [], 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = [self.pattern.findall(t) for t in texts]
        self.learn(chain.from_iterable(words))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, w)), "<i4") for w in words]

    def digits(self, ids: np.ndarray) -> bytes:
        return ",".join(map(self.decimal.__getitem__, ids.tolist())).encode()

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of each id list: pieces in the order of their positions. Long lists are taken
        in parts and several short ones together, so a query holds a bounded number of tokens."""
        out = [bytearray() for _ in ids]
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush():
            flat = np.concatenate([x for _, x in held])
            owner = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for _, x in held])
            self._load("tokens", {"d": owner, "pos": np.arange(len(flat), dtype=np.int32), "id": flat})
            got = self.con.sql(DECODE).to_arrow_table()
            text = dict(zip(got["d"].to_pylist(), got["text"].to_pylist()))
            for k, (i, _) in enumerate(held):
                out[i] += np.frombuffer(text.get(k, "").encode("utf-16-le"), np.uint8)[::2].tobytes()

        for i, x in enumerate(ids):
            for at in range(0, len(x), DECODE_TOKENS):
                held.append((i, x[at : at + DECODE_TOKENS]))
                size += len(held[-1][1])
                if size >= DECODE_TOKENS:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return [bytes(b) for b in out]


def grouped(texts: list[str]):
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def tokenized(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, exact, ids) per row: the whole text encoded,
    each match of ``pattern`` by itself, and decoded again; ``exact`` says that the bytes agree.

    Null text is empty: no token. ``ids`` is left null without ``with_ids``. The vocabulary at
    ``path`` (of fixed size) is read once and sent to the tasks."""
    ranks = read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, merge_table(ranks)))

    def run(batches):
        codec = None
        for batch in batches:
            codec = codec or Codec(*shared.value, pattern)
            at = 0
            idents = batch.column("doc_id")
            for texts in grouped([x.as_py() or "" for x in batch.column("text")]):
                ids = codec.encode(texts)
                back = codec.decode(ids)
                rows = [
                    (len(i), hashlib.sha256(codec.digits(i)).hexdigest(), hashlib.sha256(b).hexdigest(), b == t.encode("utf-8", "replace"), i if with_ids else None)
                    for t, i, b in zip(texts, ids, back)
                ]
                n, a, b, same, i = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [idents.slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(same), pa.array(i, pa.list_(pa.int32()))],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact", "ids"],
                )
                at += len(texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean, ids array<int>"
    )
