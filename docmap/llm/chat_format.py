"""Chat formatting with spans found by rendering turn prefixes.

A template is any object with ``render(turns) -> str`` and ``unescape``; it is
a black box.  Successive prefixes of a conversation are rendered and each
output is compared with the one before: what was added is the new turn's span.
Inside the span the text is located by rendering the same prefix with the
turn's text replaced by two probes that differ in their only character: what
the two outputs share before and after it is what the template puts around a
text.  If a later output no longer has an earlier turn's text at its place,
the template rewrites history and the row says so.

Rows are dealt by conversation and read in order of their turns, one
conversation at a time; nothing but its own turns is held for it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmap.llm.common import slices

Turn = tuple[str, str]
SPANS = "array<struct<turn:int,role:string,start:long,stop:long,text_start:long,text_stop:long>>"
SPAN_TYPE = pa.list_(pa.struct([("turn", pa.int32()), ("role", pa.string()),
                                *((c, pa.int64()) for c in ("start", "stop", "text_start", "text_stop"))]))


class TurnTemplate:
    """``### role: text</turn>`` and a line break for each turn.

    In texts a backslash, every mark of a run of three or more ``#``, and a
    ``</turn>`` get a backslash before them (in roles also a colon), so no text
    can open or close a turn, and removing the backslashes gives it back.
    """

    CONTROL = re.compile(r"\\|#{3,}|</turn>")
    IN_ROLE = re.compile(r"[\\:]|#{3,}|</turn>")
    ESCAPED = re.compile(r"\\(.)", re.DOTALL)
    TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)

    def unescape(self, text: str) -> str:
        return self.ESCAPED.sub(r"\1", text)

    def render(self, turns: list[Turn]) -> str:
        return "".join(map(_written, turns))

    def read(self, formatted: str) -> list[Turn]:
        """The turns of a rendered conversation; anything else is an error."""
        out, at = [], 0
        while at < len(formatted):
            m = self.TURN.match(formatted, at)
            if m is None:
                raise ValueError(f"no turn at character {at}")
            out.append((self.unescape(m[1]), self.unescape(m[2])))
            at = m.end()
        return out


def _marked(m: re.Match) -> str:
    return "".join("\\" + c for c in m[0]) if m[0][0] == "#" else "\\" + m[0]


@lru_cache(maxsize=2048)
def _written(turn: Turn) -> str:
    """One turn as ``TurnTemplate`` writes it; prefixes share their turns."""
    role, text = turn
    return f"### {TurnTemplate.IN_ROLE.sub(_marked, role)}: {TurnTemplate.CONTROL.sub(_marked, text)}</turn>\n"


def shared_start(x: str, y: str) -> int:
    """Number of leading characters that two texts share."""
    n = min(len(x), len(y))
    if x.startswith(y[:n]):
        return n
    low, high = 0, n  # x[:low] is shared, x[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        if x.startswith(y[low:mid], low):
            low = mid
        else:
            high = mid
    return low


def locate(template, turns: list[Turn]) -> tuple[str, list[tuple], int | None]:
    """The rendered conversation, the spans of its turns and the first turn
    whose text a later turn moved or changed (None: history is not rewritten).

    A span is (turn, role, start, stop, text_start, text_stop) in characters
    of the output; a turn that was rewritten, or whose text the template does
    not write out unchanged but for its escapes, has null places.
    """
    before, spans, rewritten = "", [], None
    for k, (role, text) in enumerate(turns):
        now = template.render(turns[:k + 1])
        start = shared_start(before, now)
        if start < len(before):  # was only what follows the last text replaced, or a text as well?
            for j in range(len(spans) - 1, -1, -1):
                turn, name, _, stop, _, text_stop = spans[j]
                if stop is None:
                    continue
                if start < text_stop:
                    spans[j] = (turn, name, None, None, None, None)
                    rewritten = turn if rewritten is None else min(rewritten, turn)
                elif start < stop:
                    spans[j] = (*spans[j][:3], start, *spans[j][4:])
                else:
                    break
        x, y = (template.render([*turns[:k], (role, probe)]) for probe in "xy")
        head = shared_start(x, y)
        tail = len(x) - head - 1
        stop = len(now) - tail
        ok = len(x) == len(y) and head >= start and head <= stop and template.unescape(now[head:stop]) == text
        spans.append((k, role, start, len(now), head, stop) if ok else (k, role, None, None, None, None))
        before = now
    return before, spans, rewritten


def format_conversations(turns: DataFrame, template=None, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_col``, ``formatted``, ``spans`` and ``rewritten_from`` of every
    conversation; ``spans`` has the places of each turn and of its text.

    Defined results: rows are taken by turn (null first), then role, then
    text, so repeated turn numbers and repeated rows all stay; a null text or
    role is empty; a row without a conversation id is a conversation of its
    own; an empty table gives an empty result; other columns are ignored.
    """
    template = template or TurnTemplate()
    rows = turns.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("_role"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = rows.schema["_conv"].dataType.simpleString()
    # rows without an id are dealt evenly
    spread = F.when(F.col("_conv").isNull(), F.monotonically_increasing_id() % 4096)
    rows = rows.withColumn("_spread", spread)
    rows = rows.repartition("_conv", "_spread").sortWithinPartitions("_conv", "_turn", "_role", "_text").drop("_spread")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, out, size, schema = None, [], [], 0, None
        names = [f.name for f in SPAN_TYPE.value_type]

        def batch() -> pa.RecordBatch:
            ids, formatted, spans, rewritten = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(ids, schema[0].type), pa.array(formatted, pa.string()), pa.array(
                [[dict(zip(names, s)) for s in x] for x in spans], SPAN_TYPE), pa.array(rewritten, pa.int32())], names=["_conv", "formatted", "spans", "rewritten_from"])

        for part in slices(batches, 1024):
            schema = part.schema
            for conv, role, text in zip(part["_conv"].to_pylist(), part["_role"].to_pylist(), part["_text"].to_pylist()):
                if held and (conv is None or conv != current):
                    out.append((current, *locate(template, held)))
                    size += len(out[-1][1])
                    held = []
                    if len(out) >= 512 or size >= 4_000_000:
                        yield batch()
                        out, size = [], 0
                current = conv
                held.append((role, text))
        if held:
            out.append((current, *locate(template, held)))
        if out:
            yield batch()

    return rows.mapInArrow(run, f"_conv {kind}, formatted string, spans {SPANS}, rewritten_from int").withColumnRenamed("_conv", conv_col)


def read_back(formatted: DataFrame, template=None, loss_role: str = "assistant", conv_col: str = "conv_id") -> DataFrame:
    """Digests of what the output says: its turns, and the text under the loss
    mask (the places of the texts of ``loss_role``), both unescaped.

    Turns that the template rewrote have no places and are not under the mask.
    """
    template = template or TurnTemplate()
    rows = formatted.select(F.col(conv_col).alias("_conv"), "formatted", F.filter(
        "spans", lambda s: (s["role"] == loss_role) & s["text_start"].isNotNull()).alias("_mask"))
    kind = rows.schema["_conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for text, mask in zip(part["formatted"].to_pylist(), part["_mask"].to_pylist()):
                turns = template.read(text)
                all_turns = hashlib.sha256()
                for role, said in turns:
                    all_turns.update(f"{role}\n{said}\n".encode())
                loss = "".join(template.unescape(text[s["text_start"]:s["text_stop"]]) for s in mask)
                out.append((len(turns), all_turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([part["_conv"], *(pa.array(c, t) for c, t in zip(
                columns, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())))], names=[
                "_conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return rows.mapInArrow(run, f"_conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                "formatted_chars long").withColumnRenamed("_conv", conv_col)
