"""Factorisation machine, periodic runs and repair of conversations against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import conversations, factors, periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string"
SF = "/root/testdata/sf0.1"


def doc_rows(rng):
    syllables = ["ka", "lo", "mi", "re", "tu", "sha", "po"]
    prose = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))
    texts = [prose(rng.choice([3, 40, 200])) for _ in range(30)]
    texts += [None, "", " \t\n", "one", "a " * 3000, "x" * 100_000, ("b c d\n" * 40) + "e " + "f g " * 30, texts[0], texts[0], "Été  x  y " * 20]
    return [(k, t, None, None, None if k % 5 == 0 else len(t or ""), "w") for k, t in enumerate(texts)] + [(None, "a b " * 30, "x", "y", 3, "w"), (3, texts[3], None, None, 1, "w")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(doc_rows(random.Random(5)), DOCS).repartition(3).cache()


# 11 Factorisation machine


def some_rows(columns=30, n=12, seed=2):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 9, n)
    column = np.concatenate([rng.choice(columns, s, replace=False) for s in sizes])
    return factors.Rows(n, np.repeat(np.arange(n), sizes), column.astype(np.int64), rng.standard_normal(sizes.sum())), rng


def test_sums_of_squares_give_what_all_pairs_give():
    rows, rng = some_rows()
    machine = factors.Machine(30, rank=4)
    machine.b, machine.w, machine.v = 0.3, rng.standard_normal(30), rng.standard_normal((30, 4))
    for k, found in enumerate(machine.score(rows)):
        entries = list(zip(rows.column[rows.doc == k], rows.value[rows.doc == k], strict=True))
        total = machine.b + sum(machine.w[i] * x for i, x in entries) + sum(machine.v[i] @ machine.v[j] * x * y for (i, x), (j, y) in itertools.combinations(entries, 2))
        assert found == pytest.approx(1 / (1 + np.exp(-total)))


def test_gradients_are_those_of_differences():
    rows, rng = some_rows()
    machine = factors.Machine(30, rank=3)
    machine.w, machine.v = rng.standard_normal(30), rng.standard_normal((30, 3))
    labels, weights = rng.integers(0, 2, rows.n).astype(float), rng.random(rows.n)
    db, there, dw, dv = machine.gradients(rows, labels, weights)
    step = 1e-6
    for array, at, expected in [(machine.w, (there[1],), dw[1]), (machine.w, (there[5],), dw[5]), (machine.v, (there[2], 1), dv[2, 1]), (machine.v, (there[7], 2), dv[7, 2])]:
        array[at] += step
        more = machine.loss(rows, labels, weights)
        array[at] -= 2 * step
        less = machine.loss(rows, labels, weights)
        array[at] += step
        assert (more - less) / (2 * step) == pytest.approx(expected, abs=1e-5)
    machine.b += step
    assert (machine.loss(rows, labels, weights) - factors_loss_below(machine, rows, labels, weights, step)) / (2 * step) == pytest.approx(db, abs=1e-5)


def factors_loss_below(machine, rows, labels, weights, step):
    machine.b -= 2 * step
    return machine.loss(rows, labels, weights)


def test_pairs_are_learned_that_no_weights_can_express():
    """Labels are whether two columns agree: linear weights are at chance, factors are not."""
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 2, 400), rng.integers(0, 2, 400)
    rows = factors.Rows(400, np.repeat(np.arange(400), 2), np.stack([a, 2 + b], axis=1).ravel().astype(np.int64), np.ones(800))
    machine = factors.Machine(4, rank=4)
    machine.fit(rows, (a == b).astype(float), np.ones(400), epochs=60)
    assert ((machine.score(rows) > 0.5) == (a == b)).mean() > 0.99


def test_vectors_do_not_depend_on_the_batch(docs):
    texts = [(r.text or "").encode() for r in docs.orderBy("doc_id").collect()]
    numbers = [np.array([np.nan if k % 3 else float(k) for k in range(len(texts))])]
    together = factors.vectors(texts, numbers)
    machine = factors.Machine(factors.width())
    machine.w = np.random.default_rng(1).standard_normal(len(machine.w))
    alone = [machine.score(factors.vectors([t], [numbers[0][k : k + 1]]))[0] for k, t in enumerate(texts)]
    assert machine.score(together).tolist() == alone
    assert together.of(np.array([3, 0])).n == 2


def test_scores_of_all_rows_and_of_nothing_labelled(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)] + [(None, 1, 0), (2, None, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    machine = factors.train(*factors.sample(docs, labels, most=8))
    rows, y, weights = factors.sample(docs, labels, most=8)
    assert rows.n == 16 and y.sum() == 8 and weights.min() > 0
    found = factors.scored(docs, machine).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    none = factors.train(*factors.sample(docs, labels.limit(0)))
    assert {r.score for r in factors.scored(docs.drop("n_chars"), none).collect()} == {0.5}
    assert factors.scored(docs.limit(0), machine).count() == 0 and factors.sample(docs.limit(0), labels)[0].n == 0


def test_quality_of_documents_that_were_not_learned_from(spark):
    found = queries.op11_factors(spark, SF)
    held = found.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (held.predicted == held.quality).mean() > 0.99
    assert held[held.quality == 1].predicted.mean() > 0.995
    ids = {r.doc_id for r in found.where("held_out").select("doc_id").collect()}
    assert ids == {k for (k,) in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect() if zlib.crc32(str(k).encode()) % 5 == 0}


# 12 Periodic runs


def plain_runs(words):
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    words = []
    for _ in range(rng.randint(0, 6)):
        base = [rng.choice("abcd"[: rng.randint(1, 4)]).encode() for _ in range(rng.randint(1, 12))]
        kind = rng.random()
        words += base * rng.randint(1, 12) + base[: rng.randint(0, len(base))] if kind < 0.6 else (base * 4 + [b"z"]) * rng.randint(1, 5) if kind < 0.8 else base
    return words


def test_runs_and_remaining_words_are_those_of_a_plain_search():
    rng = random.Random(6)
    for _ in range(120):
        texts = [periodic_words(rng) for _ in range(rng.randint(0, 6))]
        for words, (found, text) in zip(texts, periodic.collapsed(texts), strict=True):
            expected = plain_runs(words)
            assert [tuple(x) for x in found.tolist()] == expected
            gone = {k for s, n, q in expected for k in range(s + q, s + n)}
            assert text == b" ".join(w for k, w in enumerate(words) if k not in gone)


def test_candidates_in_blocks_are_the_same():
    rng = random.Random(7)
    words = [w for _ in range(20) for w in periodic_words(rng)]
    symbols = np.array([1000, *[w[0] for w in words], 1001], np.int64)
    grammar, n = periodic.Grammar(symbols), np.array([len(words)])
    whole = periodic.runs(grammar, np.array([1]), n)[0]
    assert len(whole) and (periodic.runs(grammar, np.array([1]), n, together=50)[0] == whole).all()


def test_extensions_of_the_grammar_are_those_word_by_word():
    rng = np.random.default_rng(3)
    words = np.concatenate([np.repeat(rng.integers(0, 3, 150), rng.integers(1, 6, 150)), np.tile(rng.integers(0, 3, 7), 30)])
    symbols = np.concatenate([[100], words, [101]])
    grammar = periodic.Grammar(symbols)
    x, y = np.sort(rng.integers(1, len(symbols) - 1, (2, 400)), axis=0)
    x, y = x[x < y], y[x < y]

    def plain(i, j, step):
        n = 0
        while symbols[i + step * n] == symbols[j + step * n]:
            n += 1
        return n

    assert grammar.extensions(x, y).tolist() == [plain(i, j, 1) for i, j in zip(x, y, strict=True)]
    assert grammar.extensions(x, y, back=True).tolist() == [plain(i, j, -1) for i, j in zip(x, y, strict=True)]


def test_digests_of_every_row(spark, docs):
    found = sorted((r.asDict() for r in periodic.digests(docs).collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert len(found) == len(rows)
    for got, row in zip(found, rows, strict=True):
        words, n = WORD.findall(row.text or ""), len(WORD.findall(row.text or ""))
        h = zlib.crc32(str(row.doc_id).encode())
        if row.doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words) if len(set(words)) > 1 else [(0, n, 1)] * (n >= 24)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        assert (got["doc_id"], got["n_runs"], got["start"], got["length"], got["period"]) == (row.doc_id, len(runs), *best)
        assert got["exponent_milli"] == (None if best[0] is None else 1000 * best[1] // best[2])
        assert got["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert got["collapsed_sha256"] == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
    assert periodic.digests(docs.limit(0)).count() == 0
    runs = periodic.find(docs).where("n_runs > 0").collect()
    assert runs and all(len(r.runs) == r.n_runs and r.collapsed for r in runs)


# 13 Conversations


def plain_repairs(rows):
    """All edits of (initial, must_go, truncated) rows, with two inserts before each at most: the least (cost, letters)."""
    legal = re.compile("(s?(ua)+)?")
    choices = []
    for initial, must_go, truncated in rows:
        stay = [] if must_go else [("K", 3 * truncated, initial), ("R", 3 + 3 * truncated, "u"), ("R", 3 + 3 * truncated, "a")]
        choices.append([("D", 4, ""), *stay])
    inserts = [("I" * k, 3 * k, "".join(x)) for k in range(3) for x in itertools.product("ua", repeat=k)]
    best = None
    for picks in itertools.product(*[list(itertools.product(inserts, c)) for c in choices], inserts):
        flat = [x for pair in picks[:-1] for x in pair] + [picks[-1]]
        if legal.fullmatch("".join(x[2] for x in flat)):
            found = (sum(x[1] for x in flat), "".join(x[0] for x in flat))
            best = found if best is None else min(best, found)
    return best


def test_the_least_integer_is_the_cheapest_and_ascii_least_edit():
    rng = random.Random(8)
    for n, times in ((0, 1), (1, 16), (2, 40), (3, 12)):
        for _ in range(times):
            rows = [(rng.choice("suao"), rng.choice("kkbdtt")) for _ in range(n)]
            expected = plain_repairs([(i if i != "o" else "x", f in "bd", f == "t") for i, f in rows])
            assert conversations.cheapest("".join(map("".join, rows))) == expected


def step_by_step(marks):
    """The same by pairs of cost and letters, row after row; letters of equally many rows compare as a whole."""
    states = {0: (0, "")}
    for initial, fault in zip(marks[0::2], marks[1::2], strict=True):
        new = {}
        for state, (cost, letters) in states.items():
            for k in range(3):
                ways = [("D", 4, state)]
                if fault not in "bd":
                    extra = 3 * (fault == "t")
                    ways += [("R", 3 + extra, 3 if state == 2 else 2)] + [("K", extra, to) for (i, at), to in conversations.LEADS.items() if (i, at) == (initial, state)]
                for letter, more, to in ways:
                    offer = (cost + 3 * k + more, letters + "I" * k + letter)
                    new[to] = min(new.get(to, offer), offer)
                state = 3 if state == 2 else 2
        states = new
    ends = []
    for state, (cost, letters) in states.items():
        for k in range(3):
            if state in (0, 3):
                ends.append((cost + 3 * k, letters + "I" * k))
            state = 3 if state == 2 else 2
    return min(ends)


def test_long_conversations_by_halves_are_as_row_by_row():
    rng = random.Random(9)
    for n in (5, 33, 400, 3000):
        marks = "".join(rng.choice("suuuaaao") + rng.choice("kkkkbdt") for _ in range(n))
        assert conversations.cheapest(marks) == step_by_step(marks)


CONVERSATIONS = "conv_id long, turn long, role string, text string, audit string, cost long"


def plain_repaired(rows):
    """The whole contract by plain Python."""
    out, after = {r[0]: [] for r in rows}, []
    blank = lambda x: " " if x is None else str(x)
    for conv, turn, role, text, *_ in rows:
        role, text, fault = blank(role), blank(text), zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        after += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    for conv, turn, role, text in after:
        out[conv].append((turn is not None, turn or 0, role, text))
    found = []
    for conv, mine in out.items():
        mine.sort()
        seen, marks = set(), ""
        for _, _, role, text in mine:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            marks += (role[:1] if role[:1] in ("s", "u", "a") else "o") + ("b" if not bare else "d" if (role, text) in seen else "k" if bare[-1] in ".!?" else "t")
            seen.add((role, text))
        cost, audit = step_by_step(marks)
        lines, state, at = [], 0, 0
        for letter in audit:
            if letter != "D":
                if letter == "K":
                    role, state = mine[at][2], conversations.LEADS[mine[at][2][0], state]
                else:
                    state = 3 if state == 2 else 2
                    role = "user" if state == 2 else "assistant"
                lines.append(f"{role}:{'' if letter == 'I' else mine[at][3]}")
            at += letter != "I"
        turns = [t for known, t, _, _ in mine if known]
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(mine)]
        faults = marks[1::2]
        found.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return found


def conversation_rows(rng):
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, rng.choice([f"Said {turn}.", "Same!", "cut off", "Why?  \n", "", " \t", None, "  . "]), "x", 1))
    rows += [(100, k % 4000, "user" if k % 2 == 0 else "assistant", f"row {k}." if k % 7 else "cut", None, None) for k in range(5000)]
    rows += [(101, 5, "user", "again and again.", None, None)] * 3000
    return rows + rows[:20]


def test_repair_of_every_conversation(spark):
    rows = conversation_rows(random.Random(10))
    table = spark.createDataFrame(rows, CONVERSATIONS).repartition(5)
    found = conversations.repaired(table, conversations.damaged(table))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(plain_repaired(rows), key=key)
    empty = table.limit(0)
    assert conversations.repaired(empty, conversations.damaged(empty)).count() == 0


def test_repaired_rows_alternate_and_hash_to_the_digest(spark):
    rows = conversation_rows(random.Random(11))
    table = spark.createDataFrame(rows, CONVERSATIONS)
    after = conversations.damaged(table)
    lines = conversations.repaired_rows(after).orderBy("conv_id", "place").collect()
    by_conv = {}
    for r in lines:
        by_conv.setdefault(r.conv_id, []).append(r)
    for r in conversations.repaired(table, after).collect():
        mine = by_conv.get(r.conv_id, [])
        assert [x.place for x in mine] == list(range(len(mine)))
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[:1] for x in mine))
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in mine).encode()).hexdigest() == r.repaired_sha256


def test_a_tie_of_rows_is_ordered_by_role_and_text(spark):
    rows = spark.createDataFrame([(1, None, "user", "b"), (1, None, "user", "a."), (1, None, "assistant", "z")], "conv_id long, turn long, role string, text string")
    assert conversations.marks(rows).collect()[0].marks == "atukut"
