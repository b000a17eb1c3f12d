import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from plumbline.llm import conversations, queries
from plumbline.llm.conversations import GOAL, Repair, damaged, distances, kinds_of, walk

WORD = re.compile(r"[^\x20\x09-\x0D]")


def fault_of(role, text, seen):
    last = WORD.findall(text)
    if not last:
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    return "truncated" if last[-1] not in ".!?" else ""


def cheapest(messages):
    """The least cheapest audit and what it makes of the messages, by trying every edit at every place (a table over
    rows and shapes; inserts are tried until nothing gets better)."""
    shapes = ("", "s", "u", "a")  # the last initial so far
    follow = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    best = {q: (0, "", ()) if q in ("", "a") else (10**9, "", ()) for q in shapes}

    def with_inserts(best):
        for _ in range(6):
            for q in shapes:
                new, name = ("a", "assistant") if q == "u" else ("u", "user")
                cost, audit, kept = best[new]
                best[q] = min(best[q], (cost + 2, "I" + audit, ((name, ""), *kept)))
        return best

    best = with_inserts(best)
    for role, text, fault in reversed(messages):
        now = {}
        for q in shapes:
            cost, audit, kept = best[q]
            ways = [(cost + 3, "D" + audit, kept)]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (q, role[:1]) in follow:
                    cost, audit, kept = best[role[:1]]
                    ways.append((cost + more, "K" + audit, ((role, text), *kept)))
                new, name = ("a", "assistant") if q == "u" else ("u", "user")
                cost, audit, kept = best[new]
                ways.append((cost + 2 + more, "R" + audit, ((name, text), *kept)))
            now[q] = min(ways)
        best = with_inserts(now)
    return best[""]


def by_hand(rows, damage=True):
    """The definition, conversation by conversation."""
    found, kept = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv] = None
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        kept[conv] += [(turn, role, text)] * (2 if code == 3 else 1)
    for conv in found:
        order = sorted(kept[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, messages = set(), []
        for _, role, text in order:
            messages.append((role, text, fault_of(role, text, seen)))
            seen.add((role, text))
        turns = [r[0] for r in order if r[0] is not None]
        counts = [sum(m[2] == f for m in messages) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(messages, messages[1:]))
        cost, audit, out = cheapest(messages)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        found[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, digest)
    return found


def random_rows(n, longest, seed=3):
    random.seed(seed)
    roles = ["user", "assistant", "system", "tool", "User", "", None, "user", "assistant", "user", "assistant"]
    texts = ["Yes.", "No!", "What?", "cut", " ", "", None, "a. \n", "é。", "x.\x85", "Fine.\t", "\x1c"]
    rows = []
    for conv in [None, *range(n)]:
        turns = random.sample(range(longest * 2), random.randint(1, longest)) + [None] * random.choice([0, 0, 0, 1])
        rows += [(conv, t, random.choice(roles), random.choice(texts) if random.random() < 0.7 else f"{random.random()}.") for t in turns]
    random.shuffle(rows)
    return rows


def as_found(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_equals_the_definition(spark):
    rows = random_rows(400, 9)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    result = Repair(damaged(df), gone="gone").summaries()
    assert result.count() == 401 and as_found(result) == by_hand(rows)


@pytest.mark.parametrize("partitions", [3, 40])
def test_conversations_over_many_partitions(spark, partitions):
    """A conversation of half the rows, with faults that reach over its pieces, another one of equal rows, a null one."""
    rows = random_rows(20, 4, 8) + [(99, t, random.choice(["user", "assistant", "tool"]), random.choice(["A.", "B.", "cut", f"{t}.", f"{t}", ""])) for t in range(600)]
    rows += [(98, 5, "user", "Same.")] * 90 + [(None, t, "assistant", f"{t}?") for t in range(100)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        repair = Repair(damaged(df), gone="gone")
        assert as_found(repair.summaries()) == by_hand(rows)
        assert repair.pieces.filter("entry is not null").count() >= 3
        spoken = defaultdict(list)
        for r in repair.messages().orderBy("part", "position").collect():
            spoken[r.conv_id].append(f"{r.role}:{r.text}")
        digests = {k: v[-1] for k, v in by_hand(rows).items()}
        assert {k: hashlib.sha256("\n".join(spoken[k]).encode()).hexdigest() for k in digests} == digests
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_audits_are_least_in_letters():
    """Of cheapest edits: delete before insert before keep before rerole, at every place."""
    assert [audit(x) for x in ("uu", "au", "ss", "a", "u", "s", "")] == [cheapest([(r, "x.", "") for r in x])[1] for x in ("uu", "au", "ss", "a", "u", "s", "")]


def audit(roles):
    kinds = kinds_of(list(roles), bytes(len(roles)))
    return "".join(letter for letter, _, _ in walk(kinds, distances(kinds, GOAL), 0, True)[0])


def test_odd_tables(spark):
    schema = "text string, role string, turn long, conv_id string, cost string, gone boolean"
    df = spark.createDataFrame([("Hi.", "user", 1, "a", "x", True), (None, None, None, "b", "x", None), ("é" * 200_000 + ".", "user", 7, "b", "x", False)], schema)
    found = as_found(Repair(df, gone="gone").summaries())
    assert found == {"a": (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} | by_hand([("b", None, None, None), ("b", 7, "user", "é" * 200_000 + ".")], damage=False)
    assert Repair(df.limit(0)).summaries().count() == 0
    assert Repair(df, gone="gone").summaries().columns[0] == "conv_id"


def test_query_holds_over_the_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    result = queries.QUERIES["op12_conversation_repair"](spark, sf_dir)
    assert result.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert as_found(result) == by_hand(rows)
    assert conversations.SUMMARY[-1].startswith("repaired_sha256")
