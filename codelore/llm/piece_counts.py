"""Token counts of a sentencepiece BPE vocabulary.

When a vocabulary is loaded, each entry is merged on its own; those that come out as one token are the
whole tokens.  Texts split into pre-tokens where no entry of the vocabulary reaches across, so that
each counts by itself.  A pre-token that is a whole token counts one at once; only the rest is merged.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache
from itertools import repeat
from operator import add

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import string_chunks

CACHE = 600_000
SPACE = "▁"
_NONE = 1 << 60


class PieceCounter:
    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        plain = [i for i in ids if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        scores = sorted({self.model.get_score(i) for i in plain}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.order = {self.model.id_to_piece(i): place[self.model.get_score(i)] for i in plain}
        self.bytes = any(map(self.model.is_byte, ids))
        inner = {c for p in self.order if len(p) > 1 for c in p} - {SPACE}
        next_to = {p[i : i + 2] for p in self.order for i in range(len(p) - 1)}
        letters = {c for c in inner if c.isalpha()}
        #: Characters that no longer entry holds stand alone; letters and others split if no entry mixes them.
        groups = [letters, inner - letters] if not any((a in letters) != (b in letters) for a, b in next_to if SPACE not in (a, b)) else [inner]
        classes = ["".join(map(re.escape, sorted(g))) for g in groups if g]
        #: No entry holds a space mark after another character: pre-tokens may end before each mark.
        self.ends_at_marks = not any(SPACE in p.lstrip(SPACE) for p in self.order)
        pattern = "|".join([*(f"{SPACE}*[{c}]+" for c in classes), f"{SPACE}+", f"[^{''.join(classes)}{SPACE}]"])
        self.find = re.compile(pattern).findall if self.ends_at_marks else (lambda s: [s] if s else [])
        self.whole = {p for p in self.order if len(self.parts(p)) == 1}
        self.counts: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.counts.clear()
        self.counts.update(dict.fromkeys(self.whole, 1))

    def parts(self, s: str) -> list[str]:
        """Merge the best pair, leftmost first among equals, until none is an entry."""
        if len(s) > 48:
            return self._long(s)
        rank, parts = self.order.get, list(s)
        ranks = list(map(rank, map(add, s, s[1:]), repeat(_NONE)))
        left = len(ranks)
        while left and (best := min(ranks)) < _NONE:
            i = ranks.index(best)
            both = parts[i] = parts[i] + parts.pop(i + 1)
            del ranks[i]
            left -= 1
            if i < left:
                ranks[i] = rank(both + parts[i + 1], _NONE)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + both, _NONE)
        return parts

    def _long(self, s: str) -> list[str]:
        """The same with a heap, for runs without a place to split."""
        n, order = len(s), self.order
        parts: list[str | None] = list(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, s[i : i + 2]) for i in range(n - 1) if (r := order.get(s[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := order.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (r, i, both))

        while heap:
            _, i, both = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= n or len(parts[i]) + len(parts[j]) != len(both) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def merged_count(self, s: str) -> int:
        return sum(1 if p in self.order or not self.bytes else len(p.encode("utf-8")) for p in self.parts(s))

    def count(self, texts: list[str]) -> list[int]:
        counts, out = self.counts, []
        if len(counts) > CACHE:
            self.forget()
        for text in texts:
            pieces = self.find(self.model.normalize(text)) if text else []
            for p in {p for p in pieces if p not in counts}:
                counts[p] = self.merged_count(p)
            out.append(sum(map(counts.__getitem__, pieces)))
        return out


@lru_cache(maxsize=2)
def load(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` to every row; a null text counts as empty: 0, 0, false."""
    new = ["n_bytes", "n_tokens", "over_limit"]
    keep = [c for c in df.columns if c not in (*new, text)]

    def run(batches):
        counter = load(path)
        for batch in batches:
            sizes: list[int] = []
            counts: list[int] = []
            for _, chunk in string_chunks(batch.column(text)):
                sizes += (chunk.at[1:] - chunk.at[:-1]).tolist()
                counts += counter.count([chunk.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(chunk.at, chunk.at[1:])])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=[*keep, *new[:2]])

    schema = T.StructType([*df.select(*keep).schema.fields, *(T.StructField(c, T.LongType()) for c in new[:2])])
    return df.select(*keep, text).mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
