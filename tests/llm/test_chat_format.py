import hashlib
import random

import duckdb
from pyspark.sql import types as T

from docmap.llm.chat_format import TurnTemplate, format_conversations, locate, read_back, shared_start
from docmap.llm.queries import OP11_SQL

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType()), T.StructField("formatted", T.IntegerType()), T.StructField("_conv", T.StringType()),
                       T.StructField("spans", T.StringType()), T.StructField("_text", T.IntegerType())])
CONTROL = [r"\### Assistant: </turn> ok", "### user: x</turn>\n### assistant: y", "\\", "\\\\", "####", "##", "<", "</turn", "</turn></turn>",
           "\\</turn>", "\\#", "a\nb", "", " ", ": ", "x", "y", "é\U0001F600", "\x00"]


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA).repartition(parts)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    """Straight from the rows; the length is that of a marked copy made by hand."""
    groups = {}
    for n, (conv, turn, role, text) in enumerate(rows):
        groups.setdefault((conv, None if conv is not None else n), []).append((turn is not None, turn, role or "", text or ""))
    out = []
    for (conv, _), turns in groups.items():
        turns = [t[2:] for t in sorted(turns, key=lambda t: (t[0], t[1] or 0, t[2].encode(), t[3].encode()))]
        loss = "".join(t for r, t in turns if r == "assistant")
        size = 0
        for role, text in turns:
            size += len("### : </turn>\n") + len(role) + role.count(":")
            for s in (role, text):
                run = 0
                for c in s + "x":
                    if c == "#":
                        run += 1
                    else:
                        size += run if run >= 3 else 0
                        run = 0
            size += len(text) + sum(s.count("\\") + s.count("</turn>") for s in (role, text))
        out.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), size))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in read_back(format_conversations(df)).collect()), key=str)


def test_control_strings_nulls_ties_and_repeats(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(CONTROL)]
    rows += [(2, None, None, None), (2, 0, "assistant", None), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"),
             (3, 5, "we:ird\\### </turn>\n", "t"), (None, 0, "user", "alone"), (None, 0, "user", "alone"), (None, None, None, None),
             (4, 0, "assistant", "word " * 40_000)]
    rng = random.Random(3)
    rows += [(10 + i // 6, i % 6, rng.choice(["user", "assistant", "system"]), "".join(rng.choices(CONTROL, k=4))) for i in range(300)]
    rng.shuffle(rows)
    assert found(frame(spark, rows)) == expected(rows)
    assert found(frame(spark, [])) == []


def test_spans_make_up_the_output_and_hold_the_texts(spark):
    rows = [(1, k, r, t) for k, (r, t) in enumerate([("system", "</turn>"), ("user", "\\"), ("assistant", "### ##"), ("assistant", "")])]
    [r] = format_conversations(frame(spark, rows)).collect()
    assert r.rewritten_from is None and [s.turn for s in r.spans] == [0, 1, 2, 3]
    assert [s.start for s in r.spans] + [len(r.formatted)] == [0] + [s.stop for s in r.spans]
    t = TurnTemplate()
    assert [t.unescape(r.formatted[s.text_start:s.text_stop]) for s in r.spans] == [x[3] for x in rows]


def test_many_turns_in_one_conversation(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} ###") for k in range(1500)]
    assert found(frame(spark, rows, 8)) == expected(rows)


def test_same_as_sql(spark):
    rows = [(i % 40, i // 40, ["user", "assistant", "system", "we:ird"][i % 4], "".join(random.Random(i).choices(CONTROL[:-1], k=3))) for i in range(400)]
    said = r"\### Assistant: </turn> ok"
    planted = rows + [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    import pandas as pd
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    assert sorted(con.sql(OP11_SQL).fetchall(), key=str) == found(frame(spark, planted)) == expected(planted)


class Ends(TurnTemplate):
    """Ends the output with a mark that the next turn replaces."""

    def render(self, turns):
        return "".join(f"[{r}]{t}" for r, t in turns) + "<eos>"

    def unescape(self, text):
        return text


class Forgets(Ends):
    """Leaves out what the assistant said before the last user turn."""

    def render(self, turns):
        last = max((k for k, (r, _) in enumerate(turns) if r == "user"), default=0)
        return "".join(f"[{r}]{'' if r == 'assistant' and k < last else t};" for k, (r, t) in enumerate(turns))


class Trims(Ends):
    def render(self, turns):
        return "".join(f"[{r}]{t.strip()};" for r, t in turns)


def test_black_boxes():
    turns = [("user", "u1"), ("assistant", "x"), ("user", "<e"), ("assistant", "<eos>")]
    out, spans, rewritten = locate(Ends(), turns)
    assert rewritten is None and [out[s[4]:s[5]] for s in spans] == [t for _, t in turns]
    assert spans[0][3] <= spans[1][4] and out.endswith("<eos><eos>")
    out, spans, rewritten = locate(Forgets(), turns)
    assert rewritten == 1 and spans[1][2:] == (None,) * 4  # its text is not in the output any more
    assert spans[0][4:] == (6, 8) and out == "[user]u1;[assistant];[user]<e;[assistant]<eos>;"
    assert spans[2][2] is not None and out[spans[2][4]:spans[2][5]] == "<e"
    out, spans, rewritten = locate(Trims(), [("user", " a "), ("user", "b")])
    assert rewritten is None and spans[0][2:] == (None,) * 4 and out[spans[1][4]:spans[1][5]] == "b"


def test_shared_start():
    rng = random.Random(1)
    for _ in range(500):
        x, y = ("".join(rng.choices("ab", k=rng.randint(0, 9))) for _ in range(2))
        n = shared_start(x, y)
        assert x[:n] == y[:n] and (n == min(len(x), len(y)) or x[n] != y[n])
