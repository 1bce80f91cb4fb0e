import re
from collections import Counter

from mise.llm import chat_quotes as C

ROWS = [(1, 0, "user", "How do I bake bread at home?\nI have flour."), (1, 1, "assistant", "Mix the flour with water.\nThen bake it for one hour."),
        (1, 2, "user", "On Monday bot wrote:\n> Mix the flour with water.\n> Then bake it for one hour.\nWhich oven heat?"),
        (1, 3, "assistant", "> > Mix the flour with water.\n> Which oven heat?\nTwo hundred degrees."),
        (1, 4, "user", ">How do I   BAKE bread\n>at home?\nAgain the first question."),
        (1, 5, "user", "> words that nobody said before\nA quote of nothing."),
        (1, 6, "user", "ok\n> ok\nok"),
        (2, 0, "user", "Mix the flour with water."), (2, 1, "user", "> Two hundred degrees.\nquote from another talk"),
        (2, 1, "user", "> Mix the flour with water.\nsame turn again"), (2, 3, "user", None), (2, 4, "user", ""),
        (None, 1, "user", "> Mix the flour with water.\nno conversation"), (2, None, "user", "> Mix the flour with water."),
        (3, 0, "user", "> my own words come later here\nfirst"), (3, 1, "user", "my own words come later here")]
SCHEMA = "conv_id long, turn long, role string, text string, body string, thread string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA)


def test_links_threads_and_bodies(spark):
    got = {(r.conv_id, r.turn, r.body): r for r in C.reply_ordered(make(spark, ROWS)).collect()}
    assert len(got) == len(ROWS)
    at = {(c, t): r for (c, t, _), r in got.items()}
    assert at[1, 2].reply_to == 1 and at[1, 2].body == "Which oven heat?" and (at[1, 2].thread, at[1, 2].depth) == (1, 1)
    assert at[1, 3].reply_to == 2 and at[1, 3].quote_depth == 2 and (at[1, 3].thread, at[1, 3].depth) == (1, 2)
    assert at[1, 4].reply_to == 0 and at[1, 4].thread == 0
    assert at[1, 5].reply_to is None and at[1, 5].thread == 5 and at[1, 5].n_quotes == 1
    assert at[1, 6].reply_to is None and at[1, 6].body == "ok\nok"
    assert got[2, 1, "same turn again"].reply_to == got[2, 1, "quote from another talk"].reply_to == 0  # links are per turn
    assert at[2, 3].body == at[2, 4].body == "" and at[3, 0].reply_to is None
    assert at[None, 1].reply_to is None and at[2, None].thread is None


def test_deep_chain_of_replies(spark):
    rows = [(7, 0, "u", "message number zero says something")]
    rows += [(7, t, "u", f"> message number {'zero' if t == 1 else t - 1} says something\nmessage number {t} says something") for t in range(1, 40)]
    got = {r.turn: r for r in C.reply_ordered(make(spark, rows)).collect()}
    assert all(got[t].reply_to == t - 1 and got[t].thread == 0 and got[t].depth == t for t in range(1, 40))


def test_one_common_first_message(spark):
    rows = [(c, 0, "u", "the very same first message") for c in range(300)] + [(c, 1, "u", "> the very same first message\nanswer") for c in range(300)]
    got = C.reply_ordered(make(spark, rows)).where("turn = 1").select("reply_to").distinct().collect()
    assert [r.reply_to for r in got] == [0]


def brute(rows):
    """Plain statement of the linking rule for one conversation."""
    def norm(t):
        return re.sub(r"[\s>]+", " ", t).strip().lower()
    own, quotes = {}, {}
    for k, (_, turn, _, text) in enumerate(rows):
        run = []
        for line in text.split("\n"):
            m = re.match(r"((?:[ \t]*>)+)[ \t]?", line)
            depth = m.group(1).count(">") if m else 0
            content = line[m.end():] if m else line
            if run and run[-1][0] == depth:
                run[-1][1].append(content)
            else:
                run.append((depth, [content]))
        own[k] = "\n".join(x for d, ls in run if d == 0 for x in ls).strip().split("\n")
        quotes[k] = [(d, ls) for d, ls in run if d]

    def units(lines):
        paragraphs, open_ = [], []
        for x in [*lines, ""]:
            if norm(x):
                open_.append(x)
            elif open_:
                paragraphs.append(" ".join(open_))
                open_ = []
        exact = {norm(u) for u in [" ".join(lines), *paragraphs, *lines]} - {""}
        words = norm(" ".join(lines)).split(" ")
        return exact, {" ".join(words[i:i + 5]) for i in range(len(words) - 4)}
    holds = {k: units(own[k]) for k in own}
    out = []
    for k, r in enumerate(rows):
        by = {}
        for d in {d for d, _ in quotes[k]}:
            got = [units(ls) for dd, ls in quotes[k] if dd == d]
            exact, grams = set().union(*(e for e, _ in got)), set().union(*(g for _, g in got))
            weight, loose = Counter(), {}
            for u in exact:
                turns = [rows[j][1] for j in holds if u in holds[j][0]]
                if len(u) < C.SHORT:
                    turns = [max((t for t in turns if t < r[1]), default=None)]
                if turns and min(turns, key=lambda t: (t is None, t)) is not None and min(turns) < r[1]:
                    weight[min(turns)] += len(u)
            for u in grams:
                turns = [rows[j][1] for j in holds if u in holds[j][1]]
                if turns and min(turns) < r[1]:
                    loose.setdefault(min(turns), []).append(len(u) // 5)
            for t, found in loose.items():
                if 2 * len(found) >= len(grams):
                    weight[t] += sum(found)
            if +weight:
                by[d] = max((w, t) for t, w in (+weight).items())[1]
        out.append(by[min(by)] if by else None)
    return out


def test_matches_brute_force_on_derived_threads(spark):
    """Real conversations, every turn quoting lines of earlier ones."""
    import random
    rng = random.Random(8)
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()
    talks = {}
    for r in table:
        said = talks.setdefault(r.conv_id, [])
        text = r.text or ""
        for _ in range(rng.randint(0, 2)):
            if said:
                words = rng.choice(said)[3].split("\n")[0].split(" ")
                if rng.random() < 0.6:  # in part, or wrapped anew
                    at = rng.randrange(len(words))
                    words = words[at:at + rng.randint(1, 14)]
                    text = "> " + " ".join(w + ("\n>" if i % 4 == 3 else "") for i, w in enumerate(words)) + "\n" + text
                else:
                    text = f"{'> ' * rng.randint(1, 2)}{' '.join(words)}\n{'> ' if rng.random() < 0.3 else ''}\n{text}"
        said.append((r.conv_id, r.turn, r.role, text))
    rows = [r for said in talks.values() for r in said]
    got = {(r.conv_id, r.turn): r.reply_to for r in C.reply_ordered(make(spark, rows)).collect()}
    for said in talks.values():
        for r, want in zip(said, brute(said)):
            assert got[r[0], r[1]] == want
    assert sum(v is not None for v in got.values()) > 20


def test_empty_table(spark):
    assert C.reply_ordered(make(spark, [])).count() == 0


def test_sql_states_the_same(spark, tmp_path):
    """The oracle SQL over messages that do hold quotes."""
    import duckdb
    from mise.llm.queries import ORACLE
    messages = make(spark, ROWS)
    messages.coalesce(1).write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/c/*.parquet')")
    found = con.execute(ORACLE["op1_chat_quotes"])
    names = [d[0] for d in found.description]
    want = sorted(str(dict(zip(names, r))) for r in found.fetchall())
    assert sorted(str({n: r[n] for n in names}) for r in C.reply_ordered(messages).collect()) == want


def test_branches_follow_what_they_answer(spark):
    said = {t: f"what message {t} has to say" for t in range(1, 6)}
    answers = {2: 1, 3: 1, 4: 2, 5: 3}
    rows = [(c, t, "u", (f"> {said[answers[t]]}\n" if t in answers else "") + said[t]) for t in (5, 3, 1, 4, 2) for c in (9, 8)]
    got = sorted((r.position, r.conv_id, r.turn) for r in C.reply_ordered(make(spark, rows)).collect())
    assert got == [(i, c, t) for i, (c, t) in enumerate((c, t) for c in (8, 9) for t in (1, 2, 4, 3, 5))]


def test_short_partial_and_wrapped_quotes(spark):
    rows = [(1, 0, "u", "42"), (1, 1, "u", "你好吗朋友"), (1, 2, "u", "yes"), (1, 3, "u", "One long answer that runs over many words and a second line\nof it.\n\nThird paragraph."),
            (1, 4, "u", "yes"), (1, 5, "u", "> 42\nwhat?"), (1, 6, "u", "> 你好吗朋友\nfine"), (1, 7, "u", "> yes\nreally"),
            (1, 8, "u", "> One long answer that\n> runs over many words and a second\n> line of it.\nwrapped"), (1, 9, "u", "> runs over many words and\nin part"),
            (1, 10, "u", "> Third\n> paragraph.\nparagraph wrapped"), (1, 11, "u", "> many other words that nobody wrote over many words and\nmostly new")]
    got = {r.turn: r.reply_to for r in C.reply_ordered(make(spark, rows)).collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: None, 5: 0, 6: 1, 7: 4, 8: 3, 9: 3, 10: 3, 11: None}


def test_a_chain_of_many_replies_is_linear(spark):
    n = 3000
    replies = spark.range(1, n).selectExpr("7L as conv_id", "id as turn", "id - 1 as reply_to")
    ranks = C.tour_ranks(C.threads(replies)).collect()
    assert sorted((r.turn, r.left) for r in ranks) == [(t, n - t) for t in range(n)]


def test_ranks_equal_a_walk_of_random_trees(spark):
    import random
    rng = random.Random(2)
    parents = {(c, t): rng.choice([None, *range(t)]) if t else None for c in range(8) for t in range(60)}
    parents |= {(99, t): 0 for t in range(1, 1500)}  # one message that all others answer
    rows = [(c, t, p) for (c, t), p in parents.items() if p is not None]
    left = {(r.conv_id, r.turn): r.left for r in C.tour_ranks(C.threads(spark.createDataFrame(rows, "conv_id long, turn long, reply_to long"))).collect()}
    kids = {}
    for c, t, p in rows:
        kids.setdefault((c, p), []).append(t)
    for c in {c for c, _, _ in rows}:
        for root in sorted({p for cc, _, p in rows if cc == c} - {t for cc, t, _ in rows if cc == c}):
            todo, walk = [root], []
            while todo:
                at = todo.pop()
                walk.append(at)
                todo += sorted(kids.get((c, at), []), reverse=True)
            assert [left[c, t] for t in walk] == list(range(len(walk), 0, -1))


def test_derived_conversations_link(spark):
    from mise.llm.queries import chat_quotes_derived
    rows = chat_quotes_derived(spark, "/root/testdata/sf0.001").collect()
    linked = [r for r in rows if r.reply_to is not None]
    assert len(linked) > len(rows) / 4 and max(r.depth for r in rows) > 1
    assert sorted(r.position for r in rows) == list(range(len(rows)))
