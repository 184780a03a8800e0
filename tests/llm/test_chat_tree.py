import hashlib
import random

from kelpmill.llm import chat_tree as ct

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = set()
    for c, turns in convs.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        plain = "".join(f"{r}\n{t}\n" for r, t in turns)
        size = sum(len(ct.head_of(r)) + len(ct.escape(t)) + len(ct.END) for r, t in turns)
        out.add((c, len(turns), hashlib.sha256(plain.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return out


def conversations():
    draw = random.Random(4)
    texts = ["a", "b", "", None, "</turn>\n", "<turn user>\n", "\\", "\\l<", "\\\\", "x" * 300, "é\U0001f600\n"]
    rows = []
    for c in range(300):
        rows += [(c, t, draw.choice(["user", "assistant"]), draw.choice(texts[: 2 + t])) for t in range(draw.choice([1, 2, 3, 11]))]
    rows += [(1000 + c, t, r, "same") for c in range(300) for t, r in enumerate(["user", "assistant"])]
    rows += [(2000, t, "assistant", f"turn {t}") for t in range(500)]
    rows += [(None, None, None, None), (None, 1, "a>\nb<", "x"), (5000, 0, "user", "dup"), (5000, 0, "user", "dup")]
    return rows


def test_read_back(spark):
    rows = conversations()
    for chars, most in ((ct.PACK_CHARS, ct.PACK_CONVERSATIONS), (200, 7)):
        packs = ct.format_trees(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as path", "2 as nodes", "3 as part"), pack_chars=chars, pack_conversations=most)
        assert {tuple(r) for r in ct.digests(packs).collect()} == brute(rows)


def test_shared_turns_are_emitted_once_with_positions_and_attention(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}" if t < 2 else f"c{c}") for c in range(50) for t in range(4)]
    (pack,) = ct.format_trees(spark.createDataFrame(rows, SCHEMA).repartition(1)).coalesce(1).orderBy("part").limit(1).collect()
    assert pack.text.count(">\nt0<") == pack.text.count(">\nt1<") == 1
    for k, node in enumerate(pack.nodes):
        chain, at = [], node.parent
        while at >= 0:
            chain.append((pack.nodes[at].start, pack.nodes[at].end))
            at = pack.nodes[at].parent
        assert node.position == sum(e - s for s, e in chain)
        assert {p for s, e in chain for p in range(s, e)} == {p for x in node.attends for p in range(x.start, x.end)}
        assert node.parent < k


def test_empty(spark):
    assert ct.digests(ct.format_trees(spark.createDataFrame([], SCHEMA))).count() == 0
