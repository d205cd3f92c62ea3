"""Token counts under a unigram model, by forward scores that words share along a trie.

A text's pre-tokens are its words, each with the word mark in front. The distinct ones of a batch go into a trie, node
by node of which the best score of any segmentation of that prefix is computed once, from its ancestors' scores; the
node where a word ends stores how many pieces its best segmentation has. Of equal scores the one with the longer last
piece counts. A character that no piece covers costs as many tokens as it has UTF-8 bytes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Nodes of a trie, and words of a worker's table; a full one is emptied, which costs time but changes nothing.
TRIE_NODES = 400_000
TABLE_WORDS = 300_000
#: What a character without a piece scores below the lowest piece.
UNKNOWN = 10.0


@functools.lru_cache(maxsize=2)
def unigram(path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece model, without control and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}


class PrefixTrie:
    """Nodes are prefixes; node 0 is the empty one."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces, self.lowest = pieces, min(pieces.values()) - UNKNOWN
        sizes: dict[str, set[int]] = {}
        for p in pieces:
            sizes.setdefault(p[-2:], set()).add(len(p))
        self.ends = {k: tuple(sorted(v - {1}, reverse=True)) for k, v in sizes.items()}
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.best: list[float] = [0.0]
        self.count: list[int] = [0]

    def add(self, word: str) -> int:
        """Insert a word and return the pieces of its best segmentation."""
        children, best, count, pieces = self.children, self.best, self.count, self.pieces
        node, path = 0, [0]
        for i, letter in enumerate(word):
            down = children[node].get(letter)
            if down is None:
                top, n = -1e300, 0
                for k in self.ends.get(word[i - 1 : i + 1] if i else "", ()):
                    if k <= i + 1 and (score := pieces.get(word[i + 1 - k : i + 1])) is not None and (score := score + best[path[i + 1 - k]]) > top:
                        top, n = score, count[path[i + 1 - k]] + 1
                one = pieces.get(letter)
                score, more = (self.lowest, len(letter.encode("utf-8", "surrogatepass"))) if one is None else (one, 1)
                if score + best[node] > top:
                    top, n = score + best[node], count[node] + more
                down = children[node][letter] = len(best)
                children.append({})
                best.append(top)
                count.append(n)
            node = down
            path.append(node)
        return count[node]


class _Counts(dict):
    """Words, as UTF-8, to their counts."""

    def __init__(self, path: str):
        super().__init__()
        self.trie = PrefixTrie(unigram(path))

    def batch(self, words: set[bytes]) -> None:
        """Count the words that are new, in order, so that neighbours share their prefixes while the trie holds."""
        if len(self) > TABLE_WORDS:
            self.clear()
        for w in sorted(words - self.keys()):
            if len(self.trie.best) > TRIE_NODES:
                self.trie.clear()
            self[w] = self.trie.add(MARK + w.decode())


def _counted(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counts(path)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = [(t.as_py() or b"").split() for t in part.column(1)]
            distinct = set().union(*texts)
            counts.batch(distinct)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(map(counts.__getitem__, t)) for t in texts], pa.int64())], names=["k", "w", "n"])


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, `n_words`, `n_tokens`, over the whole text. A null text has none; repeated rows count alike."""
    key = docs.schema[id_col].dataType.simpleString()
    df = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    return df.mapInArrow(lambda batches: _counted(path, batches), f"k {key}, w long, n long").toDF(id_col, "n_words", "n_tokens")
