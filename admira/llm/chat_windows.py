"""Chat formatting in budgeted windows, in DataFrame functions only.

Turns get token counts and their prefix sums within the conversation; turns are dealt by ranges of their order, so that a
long conversation is spread over tasks. Spans of whole turns are chosen so that a span's tokens, a difference of two prefix
sums, fit the budget left by the system turn and the history. Each span makes one window: the system turn (kept in every
window), the last turns before the span as far as ``turns`` and ``tokens`` of history allow, then the span itself. The loss
mask covers the assistant texts of the span alone: a target repeated as history is masked out, so every assistant text is
learned once.

A turn counts a token at least, so a span has ``budget`` turns at most. Spans are chosen from the numbers of the turns, in
blocks of that many turns: where a block is entered decides where the next one is, a table of ``budget`` small numbers. These
tables are put together ``FAN`` at a time, level by level, and the entries of all blocks are read off downwards, so that spans
cross blocks and no row holds more than ``FAN`` tables or the turns of one window. Texts move once, to their windows. Only
``digest`` joins a conversation's texts in one row, for their checksum: that row must stay below 2 GB.

Template: ``<s>``, then each turn as ``[INST]role`` newline ``text[/INST]``, an assistant's as ``[ANS]text[/ANS]</s>``.
In texts and roles a backslash is doubled and a control string gets a backslash behind its first character, which
``unescape`` takes back.

Tokens are an estimate, a quarter of the bytes, unless ``tokens`` names another column function.

Defined results: null texts and roles are empty; turns go by (turn, role, text), null turns first; a first turn of role
``system`` is the system turn; repeated rows are turns of their own; a turn above the budget is a span alone; a null
conv_id is one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, running, stage

#: The control strings of the template; each has a form with and without the slash.
_CONTROL = r"(<|\[)(?=/?s>|/?INST\]|/?ANS\])"
_HEAD, _ANSWER_TAIL = "<s>", "[/ANS]</s>"
#: Tables of blocks that are put together in a row.
FAN = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def token_estimate(text: Column) -> Column:
    """A token for every four bytes, and one for the turn."""
    return F.ceil(F.octet_length(text) / 4).cast("long") + 1


def _formatted() -> Column:
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    plain = F.concat(F.lit("[INST]"), role, F.lit("\n"), escape(F.col("text")), F.lit("[/INST]"))
    return F.when(F.col("role") == "assistant", F.concat(F.lit("[ANS]"), escape(F.col("text")), F.lit(_ANSWER_TAIL))).otherwise(plain)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _entries(blocks: DataFrame, size: int, budget: int, most: int) -> DataFrame:
    """(ec, eg, at): where the spans enter each block, counted within it, for conversations of more than one block."""
    long = blocks.where(F.col("turns") > size)
    after = long.select(F.col("c").alias("ec"), (F.col("g") - 1).alias("eg"), F.col("ts").alias("later"))
    both = long.join(after, _same("c", "ec") & _same("g", "eg"), "left").select("c", "g", "room", "ts", F.concat("ts", F.coalesce("later", F.slice("ts", 1, 0))).alias("seen"))
    # ends of turns and the limits of spans in one order: the ends before a limit are the turns that the span can reach
    ends = F.transform("seen", lambda t: F.struct((t["before"] + t["tok"]).alias("at"), F.lit(0).alias("limit")))
    limits = F.transform("ts", lambda t: F.struct((t["before"] + F.col("room")).alias("at"), F.lit(1).alias("limit")))
    placed = F.transform(F.array_sort(F.concat(ends, limits)), lambda x, j: F.struct(x["limit"].alias("limit"), j.alias("j")))
    reach = F.transform(F.filter(placed, lambda x: x["limit"] == 1), lambda x, m: F.greatest(x["j"] - m, m + 1))
    opening = F.size(F.filter("seen", lambda t: t["before"] + t["tok"] <= budget))
    first = F.greatest(opening, F.lit(1))
    both = both.withColumn("reach", F.when(F.col("g") == 0, F.concat(F.array(first), F.slice(reach, 2, size))).otherwise(reach))

    def leave(acc: Column, s: Column) -> Column:
        to = F.get("reach", s)
        return F.concat(F.array(F.when(to >= size, to - size).otherwise(F.get(acc, to - s - 1))), acc)

    table = F.aggregate(F.reverse(F.sequence(F.lit(0), F.size("ts") - 1)), F.array().cast("array<int>"), leave)
    nodes, levels = both.select("c", "g", table.alias("to")), []
    while most > 1:
        kids = stage(nodes.groupBy("c", F.floor(F.col("g") / FAN).alias("up")).agg(F.sort_array(F.collect_list(F.struct("g", "to"))).alias("kids")), "levels")
        levels.append(kids)
        through = F.aggregate(F.slice("kids", 2, FAN), F.get("kids", F.lit(0))["to"], lambda acc, k: F.transform(acc, lambda e: F.get(k["to"], e)))
        nodes, most = kids.select("c", F.col("up").alias("g"), through.alias("to")), -(-most // FAN)
    known = levels[-1].select(F.col("c").alias("ec"), F.col("up").alias("eg"), F.lit(0).alias("at"))
    for kids in reversed(levels):
        start = F.struct(F.col("at").alias("at"), F.array().cast("array<struct<g:bigint,at:int>>").alias("seen"))
        step = lambda acc, k: F.struct(F.get(k["to"], acc["at"]).alias("at"), F.concat(acc["seen"], F.array(F.struct(k["g"].alias("g"), acc["at"].alias("at")))).alias("seen"))
        found = kids.join(known, _same("c", "ec") & _same("up", "eg")).select("c", F.explode(F.aggregate("kids", start, step)["seen"]).alias("e"))
        known = found.select(F.col("c").alias("ec"), F.col("e.g").alias("eg"), F.col("e.at").alias("at"))
    return known


def _starts(numbers: DataFrame, convs: int, size: int, budget: int, history_turns: int, history_tokens: int) -> tuple[DataFrame, int]:
    """(nc, ng, near): for each block the first turns of the spans that its turns may belong to; and the number of blocks."""
    heads = numbers.groupBy(F.col("c").alias("o")).agg(F.max(F.when(F.col("opens"), F.col("tok"))).alias("sys_tok"), F.count(F.lit(1)).alias("turns"))
    blocks = numbers.groupBy("c", F.floor(F.col("i") / size).alias("g")).agg(F.sort_array(F.collect_list(F.struct("i", "before", "tok"))).alias("ts"))
    room = F.lit(budget) - F.lit(history_tokens) - F.coalesce("sys_tok", F.lit(0))
    blocks = stage(blocks.join(bounded(heads, convs), _same("c", "o")).select("c", "g", "ts", "turns", room.cast("long").alias("room")), "blocks")
    n, last = blocks.agg(F.count(F.lit(1)), F.max("g")).first()
    if last:
        blocks = blocks.join(_entries(blocks, size, budget, last + 1), _same("c", "ec") & _same("g", "eg"), "left").drop("ec", "eg")
    else:
        blocks = blocks.withColumn("at", F.lit(0))
    blocks = blocks.withColumn("at", F.coalesce("at", F.lit(0)))

    def grow(acc: Column, t: Column) -> Column:
        room_now = F.when(acc["base"] == 0, F.lit(budget)).otherwise(F.col("room"))
        new = F.struct(F.concat(acc["starts"], F.array(F.struct(t["i"].alias("i"), t["before"].alias("before")))).alias("starts"), t["before"].alias("base"))
        return F.when(t["before"] + t["tok"] - acc["base"] > room_now, new).otherwise(acc)

    head = F.get("ts", F.col("at"))
    start = F.struct(F.array(F.struct(head["i"].alias("i"), head["before"].alias("before"))).alias("starts"), head["before"].alias("base"))
    found = F.aggregate(F.slice("ts", F.col("at") + 2, F.size("ts")), start, grow)["starts"]
    entered = blocks.where(F.col("at") < F.size("ts")).select("c", "g", found.alias("starts"))
    soon = F.filter("starts", lambda s: s["i"] < F.col("g") * size + history_turns)  # the block before may be their history
    sent = F.array(*[F.struct((F.col("g") + k).alias("g"), x.alias("s")) for k, x in ((0, F.col("starts")), (1, F.slice("starts", -1, 1)), (-1, soon))])
    sent = entered.select("c", F.explode(sent).alias("x")).where("x.g >= 0 AND size(x.s) > 0")
    return stage(sent.groupBy(F.col("c").alias("nc"), F.col("x.g").alias("ng")).agg(F.sort_array(F.flatten(F.collect_list("x.s"))).alias("near")), "starts"), n


def windows(turns: DataFrame, budget: int = 512, history_turns: int = 2, history_tokens: int = 96, tokens=token_estimate) -> DataFrame:
    """A row for each window: conv_id, window, n_context, n_new, formatted, loss (array of start and length from 0).

    ``window`` is the number of the span's first turn. ``n_context`` turns at the front are repeated from earlier windows.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"tok": F.greatest(tokens(F.col("text")).cast("long"), F.lit(1)), "len": F.length(_formatted()).cast("long")})
    order = [F.col("c").asc_nulls_first(), F.col("t").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    rows = running(rows, order, {"before": "tok", "off": "len"})

    convs = stage(rows.groupBy(F.col("c").alias("o")).agg(F.min("__row").alias("row0"), F.min("before").alias("before0")), "conversations")
    n = convs.count()
    rows = rows.join(bounded(convs, n), _same("c", "o")).withColumns({"i": F.col("__row") - F.col("row0"), "before": F.col("before") - F.col("before0")})
    opens = (F.col("i") == 0) & (F.col("role") == "system")
    size = max(budget, history_turns, 1)  # turns of a block: no span and no history is longer
    numbers = stage(rows.select("c", "i", "before", "tok", opens.alias("opens")), "numbers")
    near, n_blocks = _starts(numbers, n, size, budget, history_turns, history_tokens)

    turn = F.struct("i", F.col("role").alias("role"), _formatted().alias("f"), "len", "tok", "off")
    met = rows.withColumn("g", F.floor(F.col("i") / size)).join(bounded(near, n_blocks), _same("c", "nc") & _same("g", "ng"))
    own = F.element_at(F.filter("near", lambda s: s["i"] <= F.col("i")), -1)["i"]
    past = lambda s: (s["i"] > F.col("i")) & (s["i"] <= F.col("i") + history_turns) & (s["before"] - F.col("before") <= history_tokens) & ~opens
    shown = F.concat(F.array(own), F.transform(F.filter("near", past), lambda s: s["i"]))
    spans = met.select("c", turn.alias("turn"), F.explode(shown).alias("window")).groupBy("c", "window").agg(F.sort_array(F.collect_list("turn")).alias("ts"))
    systems = rows.where(opens).select(F.col("c").alias("o"), turn.alias("sys"))
    spans = spans.join(bounded(systems, n), _same("c", "o") & (F.col("window") > 0), "left")
    head = F.when(F.col("sys").isNotNull(), F.array("sys")).otherwise(F.slice("ts", 1, 0))
    context = F.concat(head, F.filter("ts", lambda t: t["i"] < F.col("window")))
    spans = spans.select("c", "window", context.alias("context"), F.filter("ts", lambda t: t["i"] >= F.col("window")).alias("new"))
    ahead = F.aggregate("context", F.lit(len(_HEAD)).cast("long"), lambda a, t: a + t["len"])
    spans = spans.withColumns({"ahead": ahead, "from": F.get("new", F.lit(0))["off"]})
    mark = len("[ANS]")
    loss = F.transform(
        F.filter("new", lambda t: t["role"] == "assistant"),
        lambda t: F.struct((F.col("ahead") + t["off"] - F.col("from") + mark).alias("start"), (t["len"] - mark - len(_ANSWER_TAIL)).alias("length")),
    )
    formatted = F.concat(F.lit(_HEAD), F.array_join(F.transform(F.concat("context", "new"), lambda t: t["f"]), ""))
    return spans.select(F.col("c").alias("conv_id"), "window", F.size("context").alias("n_context"), F.size("new").alias("n_new"), formatted.alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted window."""
    found = F.regexp_extract_all(formatted, F.lit(r"(?s)\[(?:INST|ANS)\].*?\[/(?:INST|ANS)\]"), F.lit(0))
    name = r"(?s)^\[INST\]((?:[^\\\n]++|\\.)*+)\n"

    def turn(x: Column) -> Column:
        role = F.regexp_extract(x, name, 1)
        body = F.substring(x, F.length(role) + 8, F.length(x) - F.length(role) - 14)
        said = F.substring(x, F.lit(6), F.length(x) - 11)
        is_answer = x.startswith("[ANS]")
        return F.struct(F.when(is_answer, "assistant").otherwise(unescape(role)).alias("role"), unescape(F.when(is_answer, said).otherwise(body)).alias("text"))

    return F.transform(found, turn)


def learned(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def digest(made: DataFrame) -> DataFrame:
    """Per conversation what its windows hold, read back from the formatted text and the mask."""
    new = F.slice(read_turns(F.col("formatted")), F.col("n_context") + 1, F.col("n_new"))
    said = F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = made.select("conv_id", "window", F.size(new).alias("n"), said.alias("said"), F.array_join(learned(F.col("formatted"), F.col("loss")), "").alias("target"), F.length("formatted").alias("chars"))
    whole = read.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "n", "said", "target", "chars"))).alias("w"))
    total = lambda field: F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x[field])
    joined = lambda field: F.array_join(F.transform("w", lambda x: x[field]), "")
    return whole.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(joined("said").cast("binary"), 256).alias("turns_sha256"),
        F.length(joined("target")).cast("long").alias("loss_chars"),
        F.sha2(joined("target").cast("binary"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
        F.size("w").cast("long").alias("n_windows"),
    )
