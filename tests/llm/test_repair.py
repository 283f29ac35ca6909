import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from gridloom.llm import repair

SPACES = " \t\n\x0b\x0c\r"


def damage(rows):
    """[(conv_id, turn, role, text)] after the damage, and all original ids."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        stripped = text.rstrip(SPACES)
        out.append("blank" if not stripped.lstrip(SPACES) else "duplicate" if (role, text) in seen else
                   "" if stripped[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def repairs(rows, found, most_inserts):
    """Every (cost, audit, repaired) with up to ``most_inserts`` inserts between two rows."""
    def edits(i):
        inserts = [c for n in range(most_inserts + 1) for c in itertools.product(("user", "assistant"), repeat=n)]
        for ins in inserts:
            head = (2 * len(ins), "I" * len(ins), [(r, "") for r in ins])
            if i == len(rows):
                yield head
                continue
            _, _, role, text = rows[i]
            options = [(3, "D", [])]
            if found[i] not in ("blank", "duplicate"):
                extra = found[i] == "truncated"
                options += [(extra, "K", [(role, text)]), *((2 + extra, "R", [(r, text)]) for r in ("user", "assistant"))]
            for cost, letter, made in options:
                for c, a, m in edits(i + 1):
                    yield head[0] + cost + c, head[1] + letter + a, head[2] + made + m

    for cost, audit, made in edits(0):
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in made)):
            yield cost, audit, made


def by_tuples(rows, found):
    """The cheapest repair as (cost, audit) tuples over rows and states, without integers."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    table = {}
    for i in range(len(rows), -1, -1):
        for q in follows:
            best = [(0, "", [])] if i == len(rows) and q in ("", "a") else []
            if i < len(rows):
                _, _, role, text = rows[i]
                c, a, m = table[i + 1, q]
                best.append((c + 3, "D" + a, m))
                if found[i] not in ("blank", "duplicate"):
                    extra = found[i] == "truncated"
                    for letter, cost, new in [("K", extra, role), ("R", 2 + extra, "user"), ("R", 2 + extra, "assistant")]:
                        if new[:1] and new[:1] in follows[q]:
                            c, a, m = table[i + 1, new[0]]
                            best.append((c + cost, letter + a, [(new, text), *m]))
            table[i, q] = min(best, key=lambda x: x[:2]) if best else (10 ** 9, "", [])
        for _ in range(3):  # inserts before row i, until nothing changes
            for q in follows:
                for new in ("user", "assistant"):
                    if new[0] in follows[q]:
                        c, a, m = table[i, new[0]]
                        table[i, q] = min(table[i, q], (c + 2, "I" + a, [(new, ""), *m]), key=lambda x: x[:2])
    return table[0, ""]


def brute_force(all_rows):
    out = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in all_rows}
    groups = {}
    for r in damage(all_rows):
        groups.setdefault(r[0], []).append(r)
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        found, turns = faults(rows), [r[1] for r in rows if r[1] is not None]
        cost, audit, made = by_tuples(rows, found)
        initials = [r[2][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in made)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("blank"), found.count("duplicate"),
                     found.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def conversations(rng, n, most):
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["a.", "b", "c!", "", " \n", "d?\t", "é", None, "a.", "x. y"]
    return [(int(c) if c else None, int(t) if t < most else None, roles[rng.choice(6, p=[.35, .35, .1, .1, .05, .05])], texts[rng.integers(10)])
            for c in range(n) for t in rng.integers(0, most + 1, rng.integers(1, most + 1))]


def test_solution_equals_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(0, 4))
        rows = [(1, i, rng.choice(["user", "assistant", "system", "tool"]), str(rng.choice(["a.", "b", "", f"c{i}."]))) for i in range(n)]
        found = faults(rows)
        want = min(repairs(rows, found, 2 if n < 3 else 1), key=lambda x: x[:2])
        assert by_tuples(rows, found)[:2] == want[:2] and by_tuples(rows, found)[2] == want[2]
        run = repair._Run(1, False)
        for (_, t, r, x), f in zip(rows, found):
            run.add(t, r, x, f == "blank", f != "truncated" and x.rstrip().endswith((".", "!", "?")))
        got = run.report(repair.solve)
        assert (got["cost"], got["audit"]) == want[:2] and [(t["role"], t["text"]) for t in got["turns"]] == want[2]


def test_blocks_multiply_to_the_whole():
    rng = np.random.default_rng(2)
    for _ in range(60):
        pattern = "".join(rng.choice(list("suaxbdSUAX"), rng.integers(1, 60)))
        cuts = sorted(rng.integers(0, len(pattern) + 1, 5).tolist())
        product = repair.Product()
        for a, b in zip([0, *cuts], [*cuts, len(pattern)]):
            product.add(repair.Matrix.of(pattern[a:b]))
        m = product.total()
        best = m.rows[repair.START][0]
        assert (best >> m.w.shift, m.w.letters(best)) == repair.solve(pattern)


@pytest.mark.parametrize("block", [2, 7, 512])
def test_equals_brute_force(spark, block):
    rng = np.random.default_rng(block)
    rows = conversations(rng, 40, 9)
    # A conversation with a third of all rows, many of them equal.
    rows += [(5, int(t), ["user", "assistant", "tool"][t % 3], f"{t % 11}{'.' if t % 2 else ''}") for t in rng.integers(0, 60, 150)]
    rows += [(-3, 1, "system", "s.")] * 20
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
           for r in repair.repaired_with_digest(repair.damaged(df), block_rows=block).collect()}
    want = brute_force(rows)
    assert got.keys() == want.keys()
    assert got == want


def test_long_rows_and_long_conversations(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t}" + "word " * 50_000 + ".") for t in range(60)]
    rows += [(2, t, "tool", f"{t}.") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
           for r in repair.repaired_with_digest(repair.damaged(df)).collect()}
    assert got == brute_force(rows)


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string, slice int, number string"
    empty = spark.createDataFrame([], schema)
    reports, turns = repair.repair(repair.damaged(empty))
    assert reports.collect() == [] and turns.collect() == []
    dropped = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    rows = [(7, dropped, "user", "x", 1, "n"), (None, None, None, None, None, None)]
    got = repair.repaired_with_digest(repair.damaged(spark.createDataFrame(rows, schema))).collect()
    assert {r.conv_id: (r.cost, r.audit) for r in got} == {7: (0, ""), None: tuple(brute_force([r[:4] for r in rows])[None][5:7])}
    assert next(r for r in got if r.conv_id == 7).repaired_sha256 == hashlib.sha256(b"").hexdigest()
