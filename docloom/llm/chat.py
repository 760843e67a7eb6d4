"""Chat formatting as a prefix tree.

Conversations that begin with the same turns share them: each turn in its
context is a node, and the output has every node's tokens once, depth-first,
with position ids that go on from the ancestors' and the spans of the ancestors'
tokens as attention intervals. A mask marks the tokens of assistant texts for
the loss.

Template: a turn stands between control strings; the same strings inside a text
get a backslash behind their first character, and a backslash is doubled, so no
text can end its turn, and reading back restores it.

A node is known by a 128-bit hash of its parent's, its role and its text. A
conversation's path is the nodes of its turns on end; in order of paths, which is
depth-first, the nodes that a path doesn't share with the one before it are new,
and stand next in the output. So what is sorted grows with the turns, not with
their ancestors, and the scan carries only the open path from one range of paths
to the next. Ancestors' intervals that touch are one, so an unshared conversation
of any depth has one. A conversation is read back through the spans of its
turns, from the nodes as they were laid out.

Turns go by (turn, role, text). A null role or text reads as empty; a row of
null conv_id is a conversation of its own. The same row twice is two turns. One
conversation is formed in one task, turn by turn: they depend on each other in
sequence, and only their hashes and sizes are held. A turn that any number of
conversations share is one node, summed up before it is shuffled; so is a path
that they share whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import textarrays as ta
from .shared import settle

# The template's control strings.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]", "<<SYS>>", "<</SYS>>")
AROUND = {"user": ("[INST] ", " [/INST]\n"), "assistant": ("[OUT] ", "</s>\n"), "system": ("<<SYS>>\n", "\n<</SYS>>\n")}
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parts(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the text escaped, and what stands behind."""
    if role in AROUND:
        return AROUND[role][0], escape(text), AROUND[role][1]
    return f"[ROLE]{escape(role)}[/ROLE]", escape(text), "</s>\n"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end hold the escaped text."""
    out, at = [], 0
    while at < len(formatted):
        for role, (before, behind) in AROUND.items():
            if formatted.startswith(before, at):
                start = at + len(before)
                break
        else:
            close = formatted.index("[/ROLE]", at)
            role, start, behind = unescape(formatted[at + len("[ROLE]") : close]), close + len("[/ROLE]"), "</s>\n"
        end = formatted.index(behind, start)  # a text never holds a control string
        out.append((role, unescape(formatted[start:end]), start, end))
        at = end + len(behind)
    return out


#: Bytes of a node's name.
STEP = 16
#: Nodes whose tokens a task has given already and so doesn't again, until it forgets them all.
KNOWN_NODES = 200_000
SPAN = "struct<from:long,to:long>"


def node_name(parent: bytes, role: str, text: str) -> bytes:
    r = role.encode()
    return hashlib.blake2b(parent + len(r).to_bytes(8, "little") + r + text.encode(), digest_size=STEP).digest()


TURNS = "conv_id long, node binary, depth int, ids array<int>, loss_from int, loss_to int, path binary, sizes array<int>"


def turns(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each turn, with the tokens of its node unless the task gave them before, and one with path and sizes for each whole conversation.

    The loss covers the tokens of an assistant's text.
    """
    row = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # rows without a conversation are dealt out like any others
    dealt = row.repartition(F.coalesce("conv_id", F.xxhash64("turn", "role", "text"))).sortWithinPartitions("conv_id", "turn", "role", "text")
    names = [x.split()[0] for x in TURNS.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32())]

    def batch(n: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([cols[c] if isinstance(cols.get(c), pa.Array) else pa.array(cols.get(c, [None] * n), k) for c, k in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(tokenizer, True)
        known: set[bytes] = set()
        conv, path, sizes = None, bytearray(), []
        for whole in batches:
            for b in ta.slices(whole, "text"):
                convs, roles, texts = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "role", "text"))
                ids, at = enc.ids(pa.array([x for r, t in zip(roles, texts, strict=True) for x in parts(r, t)], pa.string()))
                first, before, behind = at[::3], at[1::3], at[2::3]
                names_, depth, take, over = [], [], [], {"conv_id": [], "node": [], "path": [], "sizes": []}
                for k, (c, r, t) in enumerate(zip(convs, roles, texts, strict=True)):
                    if path and (c is None or c != conv):
                        _leaf(over, conv, path, sizes)
                        path, sizes = bytearray(), []
                    conv = c
                    name = node_name(bytes(path[-STEP:]), r, t)
                    depth.append(len(sizes))
                    path += name
                    sizes.append(int(first[k + 1] - first[k]))
                    names_.append(name)
                    take.append(None if name in known else k)
                    known.add(name)
                if len(known) > KNOWN_NODES:
                    known = set()
                mine = np.array([r == "assistant" for r in roles], bool)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.view(np.int32))).take(pa.array(take, pa.int64()))
                loss = [pa.array(np.where(mine, x - first[:-1], 0), pa.int32()) for x in (before, behind)]
                yield batch(len(names_), conv_id=convs, node=names_, depth=depth, ids=lists, loss_from=loss[0], loss_to=loss[1])
                if over["node"]:
                    yield batch(len(over["node"]), **over)
        if path:
            over = {"conv_id": [], "node": [], "path": [], "sizes": []}
            _leaf(over, conv, path, sizes)
            yield batch(1, **over)

    return dealt.select("conv_id", "role", "text").mapInArrow(ta.lean(run), TURNS)


def _leaf(over: dict[str, list], conv: int | None, path: bytearray, sizes: list[int]) -> None:
    for name, value in (("conv_id", conv), ("node", bytes(path[-STEP:])), ("path", bytes(path)), ("sizes", sizes)):
        over[name].append(value)


def _names(path: bytes) -> list[bytes]:
    return [path[k : k + STEP] for k in range(0, len(path), STEP)]


def _alike(one: list[bytes], two: list[bytes]) -> int:
    """How many names two paths begin with alike."""
    k = 0
    while k < len(one) and k < len(two) and one[k] == two[k]:
        k += 1
    return k


class Walk:
    """Depth-first over sorted paths: tokens so far, and of the open path the nodes' names, spans, positions' ends and intervals."""

    def __init__(self, total: int = 0, open_: list[tuple[bytes, int, int]] = ()):
        self.total, self.names, self.spans, self.ends, self.seen = total, [], [], [], []
        for name, start, end in open_:
            self._enter(name, start, end)

    def _enter(self, name: bytes, start: int, end: int) -> tuple[int, list[tuple[int, int]]]:
        """The position the node begins at, and the intervals of its ancestors."""
        position, above = (self.ends[-1], self.seen[-1]) if self.names else (0, [])
        self.names.append(name)
        self.spans.append((start, end))
        self.ends.append(position + end - start)
        self.seen.append([*above[:-1], (above[-1][0], end)] if above and above[-1][1] == start else [*above, (start, end)])
        return position, above

    def step(self, path: bytes, sizes: list[int]) -> list[tuple[bytes, int, int, list[tuple[int, int]]]]:
        """The new nodes of the path: name, start, position and ancestors."""
        names, out = _names(path), []
        k = _alike(names, self.names)
        for x in (self.names, self.spans, self.ends, self.seen):
            del x[k:]
        for name, n in zip(names[k:], sizes[k:], strict=True):
            out.append((name, self.total, *self._enter(name, self.total, self.total + n)))
            self.total += n
        return out


def _begins(tails: list) -> dict[int, tuple[int, list[tuple[bytes, int, int]]]]:
    """Where the walk of each range of paths begins: tokens before it, and the path open there.

    tails: of each range its part, its total as if nothing were open, its first and last path, and the last's spans.
    """
    begins, total, open_ = {}, 0, []
    for r in sorted(tails, key=lambda r: r["part"]):
        begins[r["part"]] = (total, open_)
        first, last = _names(bytes(r["first"])), _names(bytes(r["last"]))
        k = _alike(first, [x[0] for x in open_])
        given = sum(r["first_sizes"][:k])  # stands before this range already
        same = min(k, _alike(last, first))
        open_ = open_[:same] + [(name, s + total - given, e + total - given) for name, s, e in list(zip(last, r["starts"], r["ends"], strict=True))[same:]]
        total += r["total"] - given
    return begins


def prefix_tree(conversations: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """The nodes, depth-first, and the conversations with the spans of their turns.

    Nodes: (node, depth, ids, start, position_ids, ancestors, loss_from, loss_to, n_conversations);
    start is the place of the node's first token in the whole output, ancestors
    are [from, to) of it that its tokens attend to besides their own.
    Conversations: (conv_id, key, spans); key tells those of null conv_id apart.
    """
    rows = settle(turns(conversations, tokenizer))
    whole = rows.where("path IS NOT NULL")
    paths = whole.groupBy("path").agg(F.first("sizes").alias("sizes"))
    paths = settle(paths.repartitionByRange("path").sortWithinPartitions("path"))

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        walk, first = Walk(), None
        for b in batches:
            for path, sizes in zip(b.column(0), b.column(1), strict=True):
                path, sizes = path.as_py(), sizes.as_py()
                first = first or (path, sizes)
                walk.step(path, sizes)
        if first:
            row = {"part": TaskContext.get().partitionId(), "total": walk.total, "first": first[0], "first_sizes": first[1], "last": b"".join(walk.names), "starts": [s for s, _ in walk.spans], "ends": [e for _, e in walk.spans]}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("total", pa.int64()), ("first", pa.binary()), ("first_sizes", pa.list_(pa.int32())), ("last", pa.binary()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]))

    # a row for each range of paths, as long as a conversation has turns
    tails = paths.mapInArrow(tail, "part int, total long, first binary, first_sizes array<int>, last binary, starts array<long>, ends array<long>").collect()
    begins = conversations.sparkSession.sparkContext.broadcast(_begins(tails))
    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    kinds = pa.schema([("node", pa.binary()), ("start", pa.int64()), ("position", pa.int64()), ("ancestors", span), ("spans", span)])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pairs = lambda x: [{"from": a, "to": b} for a, b in x]
        walk, out, held = Walk(*begins.value.get(TaskContext.get().partitionId(), ())), [], 0
        for b in batches:
            for path, sizes in zip(b.column(0), b.column(1), strict=True):
                for node, start, position, above in walk.step(path.as_py(), sizes.as_py()):
                    out.append({"node": node, "start": start, "position": position, "ancestors": pairs(above), "spans": None})
                    held += 1 + len(above)
                out.append({"node": walk.names[-1], "start": None, "position": None, "ancestors": None, "spans": pairs(walk.spans)})
                held += len(walk.spans)
                if held > 20_000:
                    yield pa.RecordBatch.from_pylist(out, kinds)
                    out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, kinds)

    laid = settle(paths.mapInArrow(lay, f"node binary, start long, position long, ancestors array<{SPAN}>, spans array<{SPAN}>"))
    own = rows.where("path IS NULL").groupBy("node").agg(*(F.first(c, True).alias(c) for c in ("ids", "depth", "loss_from", "loss_to")), F.count("*").alias("n_conversations"))
    nodes = own.join(laid.where("start IS NOT NULL").drop("spans"), "node")
    nodes = settle(nodes.repartitionByRange("start").sortWithinPartitions("start"))
    ids = F.transform(F.sequence(F.lit(0), F.greatest(F.size("ids") - 1, F.lit(0))), lambda x: F.col("position") + x)
    nodes = nodes.select("node", "depth", "ids", "start", ids.alias("position_ids"), "ancestors", "loss_from", "loss_to", "n_conversations")
    leaves = whole.select("conv_id", "node", F.monotonically_increasing_id().alias("key")).join(laid.where("spans IS NOT NULL").select("node", "spans"), "node")
    return nodes, leaves.select("conv_id", "key", "spans")


def _each(nodes: DataFrame, leaves: DataFrame, tokenizer: str, of, schema: str) -> DataFrame:
    """Rows of schema, which ``of(conv_id, turns)`` makes of each conversation; turns gives (formatted, loss text escaped or None)."""
    asked = leaves.select("conv_id", "key", F.posexplode("spans").alias("depth", "span")).withColumn("start", F.col("span.from"))
    got = asked.join(nodes.select("start", "ids", "loss_from", "loss_to"), "start").select("key", "conv_id", "depth", "ids", "loss_from", "loss_to")
    dealt = got.repartition("key").sortWithinPartitions("key", "depth")
    names, kinds = [x.strip().split()[0] for x in schema.split(",")], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import itertools

        tok = bpe.encoder(tokenizer, True).tok
        back = {c: b for b, c in bpe._byte_chars().items()}
        words: dict[int, bytes] = {}

        def decoded(ids: list[int]) -> str:
            for i in ids:
                if i not in words:
                    words[i] = bytes(map(back.__getitem__, tok.id_to_token(i)))
            return b"".join(map(words.__getitem__, ids)).decode()

        def rows():
            for b in batches:
                lists, ends = b.column(3).flatten(), np.concatenate([[0], np.cumsum(b.column(3).value_lengths().to_numpy())])
                for k, (key, conv, a, z) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 4, 5)), strict=True)):
                    ids = lists[int(ends[k]) : int(ends[k + 1])].to_pylist()
                    yield key, conv, decoded(ids), decoded(ids[a:z]) if z > a else None

        out = []
        for _, group in itertools.groupby(rows(), key=lambda r: r[0]):
            one = next(group)
            out.append(of(one[1], ((x[2], x[3]) for x in itertools.chain([one], group))))
            if len(out) == 256:
                yield as_batch(out)
                out = []
        yield as_batch(out)

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        cols = zip(*out, strict=True) if out else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)

    known = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    kinds = [known[x.strip().split()[1]] for x in schema.split(",")]
    return dealt.mapInArrow(ta.lean(run), schema)


def read_back(nodes: DataFrame, leaves: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, formatted, loss): every conversation's string out of the tree, and what its loss mask covers, escaped."""

    def of(conv, turns):
        whole, loss = zip(*turns, strict=True)
        return conv, "".join(whole), [x for x in loss if x is not None]

    return _each(nodes, leaves, tokenizer, of, "conv_id long, formatted string, loss array<string>")


def digests(nodes: DataFrame, leaves: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what the tree's output gives; a turn is held at a time."""

    def of(conv, turns):
        said, heard, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for formatted, loss in turns:
            for role, text, _, _ in parse(formatted):
                said.update(f"{role}\n{text}\n".encode())
                n += 1
            text = unescape(loss or "")
            heard.update(text.encode())
            chars, size = chars + len(text), size + len(formatted)
        return conv, n, said.hexdigest(), chars, heard.hexdigest(), size

    return _each(nodes, leaves, tokenizer, of, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
