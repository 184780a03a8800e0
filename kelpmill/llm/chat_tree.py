"""Chat formatting as prefix trees: conversations that begin with the same turns share them.

Conversations are sorted by the path of their turns, so that those which share turns are neighbours, and packed one
after another into sequences of bounded length. A pack is a tree whose nodes are formatted turns; the sequence holds
every node once, depth first. A node comes with the position id of its first token (positions count along the path from
the root) and with the intervals of the sequence that its tokens may attend to: all its ancestors. Tokens are code points
here, so a tokenizer can be put behind it turn by turn.

A turn is `<turn ROLE>`, a line feed, the text, `</turn>` and a line feed. In texts and roles a backslash is written
`\\\\` and `<` is written `\\l`; in roles, `>` and line feeds are `\\g` and `\\n`. So no text can hold a control string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

#: Characters after which a pack is closed; a longer conversation makes a longer pack.
PACK_CHARS = 65_536
#: Conversations after which a pack is closed: equal ones add no characters.
PACK_CONVERSATIONS = 2_048
#: Turns by which conversations are dealt to tasks; in a task they are sorted by all their turns.
DEAL_TURNS = 64
LOSS_ROLE = "assistant"
END = "</turn>\n"
_HEAD = re.compile(r"<turn ([^>]*)>\n")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PLAIN = {"\\": "\\", "l": "<", "g": ">", "n": "\n"}

PACK = "part int, nth int, text string, nodes array<struct<start:int,end:int,parent:int,position:int,loss_start:int,loss_end:int,attends:array<struct<start:int,end:int>>>>, leaves array<struct<conv_id:{id},node:int>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text) if "\\" in text else text


def head_of(role: str) -> str:
    role = escape(role).replace(">", "\\g").replace("\n", "\\n")
    return f"<turn {role}>\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns = []
    for piece in formatted.split(END)[:-1]:
        head = _HEAD.match(piece)
        turns.append((unescape(head[1]), unescape(piece[head.end() :])))
    return turns


class Node(NamedTuple):
    parent: int
    role: str
    text: str
    children: dict[tuple[str, str], int]


class Tree:
    """The turns of the conversations of one pack."""

    def __init__(self):
        self.nodes, self.roots, self.leaves, self.chars = [], {}, [], 0

    def missing(self, turns: list[tuple[str, str]]) -> int:
        """Characters that these turns would add."""
        level, at = self.roots, 0
        while at < len(turns) and turns[at] in level:
            level, at = self.nodes[level[turns[at]]].children, at + 1
        return sum(len(head_of(r)) + len(escape(t)) + len(END) for r, t in turns[at:])

    def add(self, conv_id, turns: list[tuple[str, str]]) -> None:
        self.chars += self.missing(turns)
        level, node = self.roots, -1
        for turn in turns:
            if turn not in level:
                level[turn] = len(self.nodes)
                self.nodes.append(Node(node, *turn, {}))
            node = level[turn]
            level = self.nodes[node].children
        self.leaves.append((conv_id, node))

    def laid_out(self) -> tuple[str, list[dict], list[dict]]:
        """(sequence, nodes, leaves), nodes numbered depth first."""
        pieces, out, number, at = [], [], {-1: -1}, 0
        stack = list(reversed(self.roots.values()))
        while stack:
            k = stack.pop()
            node = self.nodes[k]
            number[k] = len(out)
            head, body = head_of(node.role), escape(node.text)
            size = len(head) + len(body) + len(END)
            pieces += [head, body, END]
            above = out[number[node.parent]] if node.parent >= 0 else None
            attends = [dict(x) for x in above["attends"]] if above else []
            if above:
                if attends and attends[-1]["end"] == above["start"]:
                    attends[-1]["end"] = above["end"]
                else:
                    attends.append({"start": above["start"], "end": above["end"]})
            loss = (at + len(head), at + len(head) + len(body)) if node.role == LOSS_ROLE else (at, at)
            position = above["position"] + above["end"] - above["start"] if above else 0
            out.append({"start": at, "end": at + size, "parent": number[node.parent], "position": position, "loss_start": loss[0], "loss_end": loss[1], "attends": attends})
            at += size
            stack.extend(reversed(node.children.values()))
        return "".join(pieces), out, [{"conv_id": c, "node": number[k]} for c, k in self.leaves]


def conversations_of(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order of turn, role and text; a conversation is one row."""
    text = lambda c: F.coalesce(turns[c].cast("string"), F.lit(""))
    rows = turns.select(turns[id_col].alias("conv_id"), F.struct(turns["turn"].alias("turn"), text("role").alias("role"), text("text").alias("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def format_trees(turns: DataFrame, id_col: str = "conv_id", pack_chars: int = PACK_CHARS, pack_conversations: int = PACK_CONVERSATIONS) -> DataFrame:
    """The packs, one a row: text, nodes with positions and attention intervals, and the leaf of each conversation.

    Null roles and texts count as empty; rows with a null id are one conversation; rows of one turn number follow each
    other by role and text, repeated rows too. Other columns are ignored. No turns give no packs.
    """
    convs = conversations_of(turns, id_col)
    path = F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"]))
    n = shuffle_partitions(turns.sparkSession)
    dealt = convs.withColumn("path", path).repartitionByRange(n, F.slice("path", 1, DEAL_TURNS), "conv_id").sortWithinPartitions("path", "conv_id")
    rows = dealt.select(F.spark_partition_id().alias("part"), "conv_id", "turns.role", "turns.text")
    schema = PACK.format(id=rows.schema["conv_id"].dataType.simpleString())

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, nth, part = Tree(), 0, 0

        def closed() -> pa.RecordBatch:
            text, nodes, leaves = tree.laid_out()
            return pa.RecordBatch.from_pylist([{"part": part, "nth": nth, "text": text, "nodes": nodes, "leaves": leaves}], pack_schema(conv_type))

        for batch in batches:
            conv_type = batch.schema.field(1).type
            parts, ids, roles, texts = batch.columns
            for k in range(batch.num_rows):
                part = parts[k].as_py()
                own = list(zip(roles[k].as_py(), texts[k].as_py(), strict=True))
                if tree.leaves and (tree.chars + tree.missing(own) > pack_chars or len(tree.leaves) >= pack_conversations):
                    yield closed()
                    tree, nth = Tree(), nth + 1
                tree.add(ids[k].as_py(), own)
        if tree.leaves:
            yield closed()

    return rows.mapInArrow(packs, schema)


def pack_schema(conv_type: pa.DataType) -> pa.Schema:
    whole = pa.int32()
    span = pa.struct([("start", whole), ("end", whole)])
    node = pa.struct([(c, whole) for c in ("start", "end", "parent", "position", "loss_start", "loss_end")] + [("attends", pa.list_(span))])
    return pa.schema([("part", whole), ("nth", whole), ("text", pa.string()), ("nodes", pa.list_(node)), ("leaves", pa.list_(pa.struct([("conv_id", conv_type), ("node", whole)])))])


def read_back(text: str, nodes: list[dict], leaf: int) -> tuple[str, str]:
    """(formatted conversation, its text under the loss mask) of a leaf, by its attention intervals."""
    node = nodes[leaf]
    formatted = "".join(text[x["start"] : x["end"]] for x in [*node["attends"], node])
    spans = []
    while leaf >= 0:
        spans.append(text[nodes[leaf]["loss_start"] : nodes[leaf]["loss_end"]])
        leaf = nodes[leaf]["parent"]
    return formatted, "".join(map(unescape, reversed(spans)))


def digests(packs: DataFrame) -> DataFrame:
    """Per conversation, what the packs give back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    id_type = packs.schema["leaves"].dataType.elementType["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv_type = batch.schema.field("leaves").type.value_type.field("conv_id").type
            kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            for k in range(batch.num_rows):
                text, nodes, leaves = (batch.column(c)[k].as_py() for c in ("text", "nodes", "leaves"))
                rows, of = [], {}
                for leaf in leaves:
                    if leaf["node"] not in of:
                        formatted, loss = read_back(text, nodes, leaf["node"])
                        turns = parse(formatted)
                        plain = "".join(f"{role}\n{body}\n" for role, body in turns)
                        of[leaf["node"]] = (len(turns), hashlib.sha256(plain.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))
                    rows.append((leaf["conv_id"], *of[leaf["node"]]))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return packs.select("text", "nodes", "leaves").mapInArrow(read, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


CONTROL_CASE = r"\### Assistant: </turn> ok"


def op5_chat_formatting(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    case = spark.createDataFrame([(-7, 0, "user", CONTROL_CASE), (-7, 1, "assistant", CONTROL_CASE)], turns.schema)
    return digests(format_trees(turns.unionByName(case)))


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS plain,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(replace(replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<', '\l')) + 16)::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(plain) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
QUERIES = {"op5_chat_formatting": (op5_chat_formatting, ORACLE_SQL)}
