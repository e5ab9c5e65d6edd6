"""Edit-aware token counts (operator 4).

A document is cut into leaves of about ``leaf`` characters at places where the pre-tokenizer always begins a token,
whatever stands around: where white space follows another character, or where letters, digits and other characters
meet (an apostrophe before letters aside, as contractions hold both).  Tokens never cross a cut, so counts add up.  A
document's leaves are the leaves of a balanced tree whose nodes hold characters and tokens.  ``build_trees`` stores the
leaves and their counts per document; ``edit_trees`` reads them, and an edit splits the tree at the leaves it touches
(and a neighbour whose cut it could have moved), encodes those leaves only, and joins the parts again, which updates
the sums on two paths.  Its result is a table of trees too, so later edits go on from there.

Defined cases: a null or empty text has one empty leaf and 0 tokens; null or empty edits change nothing; an edit is
clipped to the text as it is when its turn comes, a null replacement deletes; edits apply in array order; repeated rows
are counted alike; an empty table gives an empty table; other columns are ignored.  A run of one kind of characters
without white space is one pre-token and so one leaf, of any length.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import documents, small_batches, stored

#: Read on the driver only; the workers get its bytes.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's published pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 512
_CUT = regex.compile(r"(?<=\S)\s|(?<=\p{L})[^\p{L}\s]|(?<=\p{N})[^\p{N}\s]|(?<=[^\s\p{L}\p{N}])\p{N}|(?<=[^\s\p{L}\p{N}'])\p{L}")


def encoding(vocabulary: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class _Node:
    """A leaf with its text, or the sums of two subtrees."""

    __slots__ = ("chars", "height", "left", "leaves", "right", "text", "tokens")

    def __init__(self, left=None, right=None, text: str = "", tokens: int = 0):
        self.left, self.right, self.text = left, right, text
        if left is None:
            self.chars, self.tokens, self.leaves, self.height = len(text), tokens, 1, 0
        else:
            self.chars, self.tokens, self.leaves = left.chars + right.chars, left.tokens + right.tokens, left.leaves + right.leaves
            self.height = 1 + max(left.height, right.height)


def _balanced(nodes: list[_Node]) -> _Node | None:
    if len(nodes) < 2:
        return nodes[0] if nodes else None
    half = len(nodes) // 2
    return _Node(_balanced(nodes[:half]), _balanced(nodes[half:]))


def _join(a: _Node | None, b: _Node | None) -> _Node | None:
    """One tree of the leaves of two; as deep as a balanced tree of them up to a constant."""
    if a is None or b is None:
        return a or b
    if abs(a.height - b.height) <= 1:
        return _Node(a, b)
    if a.height > b.height:
        keep, part = a.left, _join(a.right, b)
        if part.height <= keep.height + 1:
            return _Node(keep, part)
        if part.left.height > part.right.height:
            return _Node(_Node(keep, part.left.left), _Node(part.left.right, part.right))
        return _Node(_Node(keep, part.left), part.right)
    keep, part = b.right, _join(a, b.left)
    if part.height <= keep.height + 1:
        return _Node(part, keep)
    if part.right.height > part.left.height:
        return _Node(_Node(part.left, part.right.left), _Node(part.right.right, keep))
    return _Node(part.left, _Node(part.right, keep))


def _split(t: _Node | None, k: int) -> tuple[_Node | None, _Node | None]:
    """The first ``k`` leaves and the others."""
    if t is None or k <= 0:
        return None, t
    if k >= t.leaves:
        return t, None
    if k <= t.left.leaves:
        a, b = _split(t.left, k)
        return a, _join(b, t.right)
    a, b = _split(t.right, k - t.left.leaves)
    return _join(t.left, a), b


def _leaves(t: _Node | None) -> Iterator[_Node]:
    todo = [t] if t else []
    while todo:
        x = todo.pop()
        if x.left is None:
            yield x
        else:
            todo += [x.right, x.left]


class TokenTree:
    """The tree of one text; ``encoded`` counts the characters it had to encode."""

    def __init__(self, text: str, count: Callable[[list[str]], list[int]], leaf: int = LEAF, state: tuple[list[int], list[int]] | None = None):
        self.count, self.leaf, self.encoded = count, leaf, 0
        if state is None:
            self.root = _balanced(self._made(text))
        else:
            at, nodes = 0, []
            for chars, tokens in zip(*state, strict=True):
                nodes.append(_Node(text=text[at : at + chars], tokens=tokens))
                at += chars
            self.root = _balanced(nodes)

    def _made(self, text: str) -> list[_Node]:
        """Leaves of a text, encoded."""
        parts, at = [], 0
        while len(text) - at > self.leaf:
            m = _CUT.search(text, at + self.leaf)
            if m is None:
                break
            parts.append(text[at : m.start()])
            at = m.start()
        parts.append(text[at:])
        self.encoded += len(text)
        return [_Node(text=p, tokens=n) for p, n in zip(parts, self.count(parts), strict=True)]

    @property
    def total(self) -> int:
        return self.root.tokens

    @property
    def size(self) -> int:
        return self.root.chars

    def text(self) -> str:
        return "".join(x.text for x in _leaves(self.root))

    def state(self) -> tuple[list[int], list[int]]:
        return [x.chars for x in _leaves(self.root)], [x.tokens for x in _leaves(self.root)]

    def _find(self, pos: int) -> tuple[int, int]:
        """The number of the leaf that holds the character at a position (the last one for the end), and where it begins."""
        t, i, begin = self.root, 0, 0
        while t.left is not None:
            if pos >= begin + t.left.chars and t.right.chars:
                i, begin, t = i + t.left.leaves, begin + t.left.chars, t.right
            else:
                t = t.left
        return i, begin

    def edit(self, start: int, end: int, new: str) -> None:
        start = min(max(start, 0), self.size)
        end = min(max(end, start), self.size)
        # A cut stands if the characters on both sides of it do, so a leaf that begins at ``start`` takes the one
        # before it along, and one that begins at ``end`` is encoded again itself.
        first, begin = self._find(max(start - 1, 0))
        last = self._find(end)[0]
        before, rest = _split(self.root, first)
        touched, after = _split(rest, last + 1 - first)
        old = "".join(x.text for x in _leaves(touched))
        middle = _balanced(self._made(old[: start - begin] + new + old[end - begin :]))
        self.root = _join(_join(before, middle), after)


_STATE = "body binary, leaf_chars array<int>, leaf_tokens array<int>"
_INTS = pa.list_(pa.int32())


def build_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """Store ``id, body, leaf_chars, leaf_tokens, n_chars, n_tokens`` per row; ``body`` is the compressed text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    ids = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = encoding(shared.value), zstandard.ZstdCompressor(level=3)
        count = lambda parts: [len(coder.encode_ordinary(p)) for p in parts]
        for b in batches:
            bodies, chars, tokens = [], [], []
            for x in b.column(1):
                text = x.as_py() or ""
                c, n = TokenTree(text, count, leaf).state()
                bodies.append(packer.compress(text.encode()))
                chars.append(c)
                tokens.append(n)
            cols = [b.column(0), pa.array(bodies, pa.binary()), pa.array(chars, _INTS), pa.array(tokens, _INTS), pa.array([sum(x) for x in chars], pa.int64()), pa.array([sum(x) for x in tokens], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "body", "leaf_chars", "leaf_tokens", "n_chars", "n_tokens"])

    return stored(docs.select(id_col, text_col).mapInArrow(run, f"id {ids}, {_STATE}, n_chars bigint, n_tokens bigint"), "trees")


def edit_trees(trees: DataFrame, edits_col: str = "edits", vocabulary: str = VOCABULARY, leaf: int = LEAF, keep: bool = True) -> DataFrame:
    """Apply each row's ``array<struct<start,end,text>>`` to its stored tree: the new tree, and what the edits took.

    ``n_tokens_before`` and ``n_tokens`` are counts before and after; ``n_chars_encoded`` tells how many characters the
    edits encoded again, ``n_chars_full`` how many full recounts would have.  Without ``keep`` the trees are left out.
    """
    spark = trees.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    ids = trees.schema["id"].dataType.simpleString()
    counts = ["n_chars", "n_tokens_before", "n_edits", "n_tokens", "n_chars_encoded", "n_chars_full"]
    schema = f"id {ids}, " + (f"{_STATE}, " if keep else "") + ", ".join(f"{c} bigint" for c in counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = encoding(shared.value), zstandard.ZstdCompressor(level=3)
        count = lambda parts: [len(coder.encode_ordinary(p)) for p in parts]
        for b in batches:
            out, states = [], []
            for body, chars, tokens, edits in zip(*(b.column(i) for i in range(1, 5)), strict=True):
                tree = TokenTree(zstandard.decompress(body.as_py()).decode(), count, leaf, (chars.as_py(), tokens.as_py()))
                before, full, n = tree.total, 0, 0
                for e in edits.as_py() or []:
                    if e is None or e["start"] is None or e["end"] is None:
                        continue
                    tree.edit(e["start"], e["end"], e["text"] or "")
                    n, full = n + 1, full + tree.size
                out.append((tree.size, before, n, tree.total, tree.encoded, full))
                if keep:
                    states.append((packer.compress(tree.text().encode()), *tree.state()))
            kept = [pa.array([s[k] for s in states], t) for k, t in enumerate((pa.binary(), _INTS, _INTS))] if keep else []
            names = ["id", *(["body", "leaf_chars", "leaf_tokens"] if keep else []), *counts]
            yield pa.RecordBatch.from_arrays([b.column(0), *kept, *(pa.array([o[k] for o in out], pa.int64()) for k in range(len(counts)))], names=names)

    edits = F.transform(edits_col, lambda e: F.struct(e["start"].cast("bigint").alias("start"), e["end"].cast("bigint").alias("end"), e["text"].cast("string").alias("text")))
    return trees.select("id", "body", "leaf_chars", "leaf_tokens", edits.alias("_edits")).mapInArrow(run, schema)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts under four edits each: insert after a third, replace at the middle, delete at two thirds, append."""
    trees = build_trees(documents(spark, sf_dir))
    n = F.col("n_chars")
    edit = lambda a, b, t: F.struct(F.floor(a).alias("start"), F.floor(b).alias("end"), F.lit(t).alias("text"))
    edits = F.array(edit(n / 3, n / 3, " (see note 7)"), edit(n / 2, n / 2 + 9, "revised\n"), edit(n * 2 / 3, n * 2 / 3 + 24, ""), edit(n + 100, n + 100, "\n\nUpdated."))
    out = edit_trees(trees.withColumn("edits", edits), keep=False)
    return out.select(F.col("id").alias("doc_id"), F.col("n_tokens_before").alias("n_tokens"), "n_edits", F.col("n_tokens").alias("n_tokens_after"), "n_chars_encoded", "n_chars_full")
