import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from compare import connect, differences
from conftest import FOLDER
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import conversation_repair as C
from plumbline.llm.queries import QUERIES, SQL, damaged

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
GOAL = re.compile(r"(s?(ua)+)?")


def edit_words(rows):
    """All ways to edit, with at most two turns inserted at a place: (cost, audit, initials, turns)."""
    def grow(at):
        inserts = [()] + [(a,) for a in "ua"] + [(a, b) for a in "ua" for b in "ua"]
        names = {"u": "user", "a": "assistant"}
        for put in inserts:
            start = (2 * len(put), "I" * len(put), "".join(put), [(names[r], "") for r in put])
            if at == len(rows):
                yield start
                continue
            role, text, must_go, cut_off = rows[at]
            options = [(3, "D", "", [])]
            if not must_go:
                more = 1 if cut_off else 0
                options.append((more, "K", role[:1] or "?", [(role, text)]))
                options += [(2 + more, "R", r, [(names[r], text)]) for r in "ua"]
            for tail in grow(at + 1):
                for option in options:
                    yield tuple(a + b + c for a, b, c in zip(start, option, tail))

    return [way for way in grow(0) if GOAL.fullmatch(way[2])]


def by_trying(rows):
    return min(edit_words(rows), key=lambda way: way[:2])


any_row = st.tuples(
    st.sampled_from(["system", "user", "assistant", "tool", ""]), st.just("t"), st.booleans(), st.booleans()
)


@settings(max_examples=150, deadline=None)
@given(st.lists(any_row, min_size=1, max_size=3))
def test_derivation_against_trying_all_edits(rows):
    cost, audit, _, turns = by_trying(rows)
    short = [(role[:1], must_go, cut_off) for role, _, must_go, cut_off in rows]
    ((_, weight),) = C.derive(short).items()
    assert weight == (cost, audit)
    done = C.follow(short, audit)
    lines = []
    for (before, edit, made, after, _), (role, text, *_) in zip(done, rows):
        lines += [(r, "") for r in before]
        lines += [] if edit == "D" else [(made or role, text)]
        lines += [(r, "") for r in after]
    assert lines == turns and sum(step[4] for step in done) == cost


@pytest.mark.parametrize("seed", range(20))
def test_pieces_put_together_are_one_derivation(monkeypatch, seed):
    chance = random.Random(seed)
    rows = [(chance.choice("ssuuaat"), chance.random() < 0.1, chance.random() < 0.2) for _ in range(60)]
    whole = C.derive(rows)
    for piece in (1, 2, 7):
        monkeypatch.setattr(C, "PIECE", piece)
        assert C.derive(rows) == whole


def summary(rows):
    """Of one conversation's rows (turn, role, text), nulls replaced: what ``summaries`` gives."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, judged = set(), []
    count = defaultdict(int)
    for _, role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        fault = (
            "blank" if blank else "duplicate" if (role, text) in seen
            else "truncated" if not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else None
        )
        seen.add((role, text))
        count[fault] += 1
        judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    weights = {0: (0, "", [])}
    inserts = {0: [(0, []), (2, ["user"]), (3, ["user", "assistant"])], 1: [(1, []), (2, ["user"]), (3, ["user", "assistant"])],
               2: [(2, []), (3, ["assistant"])], 3: [(3, []), (2, ["user"])]}
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def closed(weights):
        grown = {}
        for state, (cost, audit, lines) in weights.items():
            for after, put in inserts[state]:
                way = (cost + 2 * len(put), audit + "I" * len(put), lines + [f"{r}:" for r in put])
                grown[after] = min(grown.get(after, way), way)
        return grown

    for role, text, must_go, cut_off in judged:
        after = defaultdict(list)
        for state, (cost, audit, lines) in closed(weights).items():
            after[state].append((cost + 3, audit + "D", lines))
            if not must_go:
                if (state, role[:1]) in step:
                    after[step[state, role[:1]]].append((cost + cut_off, audit + "K", lines + [f"{role}:{text}"]))
                for made in ("user", "assistant"):
                    if (state, made[0]) in step:
                        after[step[state, made[0]]].append((cost + 2 + cut_off, audit + "R", lines + [f"{made}:{text}"]))
        weights = {state: min(ways) for state, ways in after.items()}
    cost, audit, lines = min(way for state, way in closed(weights).items() if state in (0, 3))
    hashed = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashed


NOTHING = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def compare_all(spark, rows, block):
    turns = spark.createDataFrame(rows, SCHEMA)
    repaired = C.repair(turns, block=block)
    found = {r.conv_id: tuple(r)[1:] for r in C.summaries(turns, repaired).collect()}
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        of[conv].append((turn, " " if role is None else role, " " if text is None else text))
    assert found == {conv: summary(turns) for conv, turns in of.items()}


@pytest.mark.parametrize("block", [1, 3, 16, 4096])
def test_blocks_of_any_size_give_the_same(spark, block):
    chance = random.Random(block)
    texts = ["Done.", "Done.", "cut off", "Why?", "", " \t", "a\nb!  ", "No end"]
    rows = [
        (conv, chance.choice([0, 1, 2, 5, None]), chance.choice(["system", "user", "assistant", "user", "tool"]),
         chance.choice(texts) + chance.choice(["", "", f" {i}."]))
        for conv, size in enumerate([1, 2, 3, 9, 40, 1, 25, 4, 4, 4]) for i in range(size)
    ]
    compare_all(spark, rows, block)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."),
        (1, 5, "", "x."), (1, 7, "system", "s."), (1, 2, "assistant", "é日本。"), (2, None, "a", None),
        (3, -4, "user", "y" * 2_000_000 + "."), (3, 9, "assistant", "z" * 2_000_000),
    ]
    compare_all(spark, rows, 4)


def test_one_conversation_with_most_rows(spark):
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}{'.' if i % 5 else ''}") for i in range(3000)]
    rows[1000] = (7, 1000, "assistant", "Twice.")
    rows[2000] = (7, 2000, "system", "Late.")
    compare_all(spark, rows + [(8, 0, "user", "Alone.")], 128)


def test_no_rows_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair(empty).collect() == [] and C.summaries(empty, C.repair(empty)).collect() == []
    clash = spark.createDataFrame(
        [(1, 0, "user", "Hi.", 3, "x", 5)],
        SCHEMA + ", place bigint, conversation string, cost bigint",
    )
    row = C.repair(clash).first()
    assert (row.place, row.conversation, row.edit, row.after) == (0, 1, "K", ["assistant"])
    assert [tuple(x) for x in row.lines] == [("user", "Hi."), ("assistant", "")]


def test_query_equals_sql(spark):
    name = "op13_conversation_repair"
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name]) == []


def test_query_against_plain_python(spark):
    of, every = defaultdict(list), set()
    for conv, turn, role, text in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect():
        every.add(conv)
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        of[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    found = {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, FOLDER).collect()}
    assert found == {conv: summary(of[conv]) if of[conv] else NOTHING for conv in every}


def test_damage_that_drops_a_whole_conversation(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}: ".encode()) % 20 == 0)
    turns = spark.createDataFrame([(gone, None, None, "Hi.")], SCHEMA)
    rows = C.summaries(turns, C.repair(damaged(turns))).collect()
    assert [tuple(r) for r in rows] == [(gone, *NOTHING)]
