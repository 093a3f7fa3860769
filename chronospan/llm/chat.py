"""Chat formatting by incremental black-box rendering (operator 10).

A template is any function from a list of turns to one string. The operator
does not look into it: it renders successive prefixes of a conversation, takes
what each turn adds as that turn's span, and finds the text within the span by
rendering the prefix twice more, with two texts that differ in one character:
where the outputs differ is where the text goes, whatever else they hold. A
template that changes what it rendered before for earlier turns ("rewrites
history") or doesn't show a turn's text once and unchanged up to escaping at its
ends is detected and raises, or marks the turn when ``strict`` is off.

Conversations of up to ``block`` turns are rendered from their first turn on.
Longer ones are cut into blocks of that many turns, and the prefixes of a block
begin with the whole block before it. So no task holds more than two blocks of
a conversation. That is right only if a turn's rendering depends on no more than
the turns of the block before, and this is checked at every seam: the turns of a
block, but for its first, must render as context of the next block exactly as
they did in their own place. A template that numbers its turns, say, fails there
and raises (or has all turns of the block marked).

Defined results: null text and null role count as empty; turns are ordered by
turn, role, text (null turn first), so repeated turns are kept in a fixed
order; empty input gives no rows; other columns are ignored, whatever their
names; a null conv_id is a conversation of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, maybe_broadcast

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
OPEN, MID, CLOSE = "[INST]", "[/INST]", "</s>"
#: Two texts of one character that templates show unchanged.
PROBES = "\ue000", "\ue001"
#: Turn numbers whose turns are ranked together.
RANKED = 1024
SPANS = "conv_id long, block long, n int, role string, formatted string, text_start int, text_end int, rewrites boolean"
#: Of a block's last turn: digests of its turns but for the first, and of those of the block before as they render as context.
SEAM = "last boolean, own long, context long"


def escape(text: str) -> str:
    """Reversible, and free of every control string: none is left without its ``<`` or ``[``."""
    return text.replace("&", "&amp;").replace("<", "&lt;").replace("[", "&#91;")


def unescape(text: str) -> str:
    return text.replace("&#91;", "[").replace("&lt;", "<").replace("&amp;", "&")


def inst_template(turns: list[Turn]) -> str:
    """``<s>``, then ``[INST]role[/INST]text</s>`` a turn; role and text escaped."""
    return "<s>" + "".join(f"{OPEN}{escape(r)}{MID}{escape(t)}{CLOSE}" for r, t in turns)


def parse_turn(formatted: str) -> Turn:
    """Role and text of one turn of :func:`inst_template`."""
    body = formatted.removeprefix("<s>")
    if not body.startswith(OPEN) or not body.endswith(CLOSE) or body.count(MID) != 1:
        raise ValueError("not one formatted turn")
    role, text = body[len(OPEN) : -len(CLOSE)].split(MID)
    return unescape(role), unescape(text)


def spans(context: list[Turn], turns: list[Turn], template: Template) -> list[tuple[str, int, int, bool]]:
    """What each turn adds after ``context``, where its text lies in that, and whether history was rewritten there or the text can't be placed."""
    done = list(context)
    before = template(done) if done else ""
    out = []
    for role, text in turns:
        now, one, two = (template([*done, (role, x)]) for x in (text, *PROBES))
        rewrites = not all(x.startswith(before) for x in (now, one, two))
        start = 0 if rewrites else len(before)
        added, one, two = now[start:], one[start:], two[start:]
        differ = [i for i, (x, y) in enumerate(zip(one, two, strict=False)) if x != y] if len(one) == len(two) else []
        at, end = (differ[0], len(added) - len(one) + differ[0] + 1) if len(differ) == 1 else (0, -1)
        placed = end >= at and added[:at] == one[:at] and added[end:] == one[at + 1 :]
        out.append((added, at, end, rewrites) if placed else (added, 0, 0, True))
        done.append((role, text))
        before = now
    return out


def digest(added: list[str]) -> int:
    """Of what the turns of a block add, but for the first, which may show where a text begins."""
    h = xxhash.xxh3_64()
    for x in added[1:]:
        h.update(f"{len(x)}:{x}".encode("utf-8", "surrogatepass"))
    return h.intdigest() - (1 << 63)


def _ranked(turns: DataFrame, block: int) -> DataFrame:
    """Rows (conv_id, block, n, role, text): turns in blocks of ``block``, by their rank, which is taken in parts of turn numbers."""
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    part = clean.withColumn("part", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / F.lit(RANKED)).cast("long"))
    sizes = part.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.sum("rows").over(before).alias("shift")).where("shift is not null")
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text"))
    shifted = part.withColumn("local", local).join(maybe_broadcast(Stored(shifts, "turn_shifts")), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left")
    rank = F.coalesce("shift", F.lit(0)) + F.col("local") - 1
    return shifted.select("conv_id", F.floor(rank / block).cast("long").alias("block"), (rank % block).cast("int").alias("n"), "role", "text")


def rendered(turns: DataFrame, template: Template, block: int) -> DataFrame:
    """Rows of ``SPANS`` and ``SEAM``, one a turn."""
    own = Stored(_ranked(turns, block), "turns").df
    later = own.where("block > 0").select(F.col("conv_id").alias("_conv"), (F.col("block") - 1).alias("_block")).distinct()
    has_next = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))
    context = own.join(maybe_broadcast(Stored(later, "turn_blocks")), has_next, "left_semi").withColumn("block", F.col("block") + 1)
    rows = own.withColumn("own", F.lit(True)).unionByName(context.withColumn("own", F.lit(False)))

    def block_rows(key: tuple, context: list[Turn], turns: list[Turn]) -> list[tuple]:
        found = spans(context, turns, template)
        mine = digest([x[0] for x in found])
        told = digest([x[0] for x in spans([], context, template)]) if context else None
        return [(*key, i, role, *x, i == len(turns) - 1, mine, told) for i, ((role, _), x) in enumerate(zip(turns, found, strict=True))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
        names = [x.split()[0] for x in f"{SPANS}, {SEAM}".split(", ")]
        key, held = None, ([], [])

        def flush() -> Iterator[pa.RecordBatch]:
            if held[1]:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*block_rows(key, *held), strict=True), kinds, strict=True)], names)

        for batch in batches:
            for conv, at, mine, role, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (conv, at) != key:
                    yield from flush()
                    key, held = (conv, at), ([], [])
                held[mine].append((role, text))
        yield from flush()

    dealt = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "own", "n")
    return dealt.select("conv_id", "block", "own", "role", "text").mapInArrow(run, f"{SPANS}, {SEAM}")


def format_conversations(turns: DataFrame, template: Template = inst_template, block: int = 32, strict: bool = True) -> DataFrame:
    """Rows (conv_id, block, n, role, formatted, text_start, text_end, rewrites), one a turn.

    A conversation's output is ``formatted`` in the order of (block, n);
    text_start and text_end are code points within it. Seams are checked at
    once; with ``strict``, ValueError tells of a template that can't be rendered so.
    """
    found = Stored(rendered(turns, template, block), "chat_spans").df
    before = F.lag("own").over(Window.partitionBy("conv_id").orderBy("block"))
    seams = found.where("last").select("conv_id", "block", "context", before.alias("was")).where("block > 0 and not (context <=> was)")
    broken = Stored(seams.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block")), "chat_seams")
    if strict:
        if found.where("rewrites").take(1):
            raise ValueError("the template rewrites history or hides a text")
        if broken.df.take(1):
            raise ValueError("the template rewrites history: a turn depends on more than the block before it")
    marked = found.join(maybe_broadcast(broken), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")), "left")
    columns = [x.split()[0] for x in SPANS.split(", ")]
    return marked.withColumn("rewrites", F.col("rewrites") | F.col("_block").isNotNull()).select(*columns)


def digests(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Read formatted turns back: rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    Turns stream through a task sorted by (conv_id, block, n); a digest's state
    is all that is held, however long a conversation is.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, started, state = None, False, None

        def fresh():
            return [0, hashlib.sha256(), 0, hashlib.sha256(), 0]

        def row():
            return (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def batch_of(rows):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            out = []
            for conv, formatted_turn, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not started or conv != key:
                    if started:
                        out.append(row())
                    key, started, state = conv, True, fresh()
                role, text = parse_turn(formatted_turn)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if role == loss_role:
                    masked = unescape(formatted_turn[a:b])
                    state[2] += len(masked)
                    state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted_turn)
            if out:
                yield batch_of(out)
        if started:
            yield batch_of([row()])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "block", "n")
    return ordered.select("conv_id", "formatted", "text_start", "text_end").mapInArrow(run, schema)
