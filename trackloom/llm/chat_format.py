"""Chat formatting: a finite-state machine over roles validates the order of turns; a declarative template turns each
conversation into text segments, each with a flag that says whether it counts in the loss. DataFrame functions only.

Control strings inside texts are escaped by a backslash after their first character, and backslashes are doubled, so the
rendered text can be read back exactly (`parse`).

Defined results: a null text, role or turn counts as empty text, empty role, first turn; rows with a null conv_id form one
conversation. Rows are ordered by turn, then role, then text, so ties and repeated rows have a fixed order and each stays
a turn of its own. A conversation out of order is formatted too, with valid = false and the index of its first wrong turn.
An empty table gives an empty one. Extra columns are not read. Texts are rendered whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base


@dataclass(frozen=True)
class Turn:
    """How the turns of one role are rendered."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    start: str
    roles: dict[str, Turn]
    #: For any other role; the role itself stands, escaped, between open and mark.
    other: Turn
    mark: str
    #: State, role -> next state. "start" is the first state; a pair that is missing is a wrong turn.
    machine: dict[tuple[str, str], str]
    final: frozenset[str]
    control: tuple[str, ...] = field(default=())

    def __post_init__(self):
        strings = {self.start, self.mark, self.other.open, self.other.close} | {s for t in self.roles.values() for s in (t.open, t.close)}
        control = tuple(sorted({s.strip() for s in (*strings, *self.control)} - {""}, key=lambda s: (-len(s), s)))
        object.__setattr__(self, "control", control)
        heads = {s[0] for s in control}
        if any(len(s) < 2 or heads & set(s[1:]) or "\\" in s for s in control):
            raise ValueError("a control string has two characters or more, none a backslash, and starts with one that no control string has later")
        opens = [t.open for t in (*self.roles.values(), self.other)]
        if len(set(opens)) < len(opens) or any(a != b and b.startswith(a) for a in opens for b in opens):
            raise ValueError("the strings that open turns must tell roles apart")


#: The production template. Assistant texts count in the loss, their marks do not.
INSTRUCT = Template(
    start="<s>",
    roles={"system": Turn("[SYS] ", " [/SYS]"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("[ANS] ", "</s>", loss=True), "tool": Turn("[TOOL] ", " [/TOOL]")},
    other=Turn("[TURN] ", " [/TURN]"),
    mark=" [TEXT] ",
    machine={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user", ("assistant", "tool"): "tool", ("tool", "assistant"): "assistant"},
    final=frozenset({"assistant"}),
)


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", text)


def escape(text: Column, template: Template) -> Column:
    r"""`\` becomes `\\`; after the first character of a control string comes a `\`."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    whole = "|".join(f"{_quote(c[0])}(?={_quote(c[1:])})" for c in template.control)
    return F.regexp_replace(doubled, f"({whole})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _look(role: Column, template: Template, pick, other) -> Column:
    found = None
    for name, turn in template.roles.items():
        value = F.lit(pick(turn))
        found = F.when(role == name, value) if found is None else found.when(role == name, value)
    return found.otherwise(other)


def format_chat(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, segments (array of struct text, loss), formatted (their concatenation), valid, wrong_turn (index of the first
    turn out of order, or the number of turns where the end comes too early; null if valid), n_turns.

    A conversation is one output row, so its turns meet in one task; there is no other shuffle.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turns = rows.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    machine = F.create_map(*(F.lit(x) for (state, name), to in template.machine.items() for x in (f"{state}\n{name}", to)))

    def step(state: Column, t: Column) -> Column:
        to = F.try_element_at(machine, F.concat(state["state"], F.lit("\n"), t["role"]))
        wrong = state["wrong"].isNotNull() | to.isNull()
        return F.struct(F.when(wrong, state["state"]).otherwise(to).alias("state"), F.when(wrong, F.coalesce(state["wrong"], state["at"])).alias("wrong"), (state["at"] + 1).alias("at"))

    def render(t: Column) -> Column:
        opened = _look(t["role"], template, lambda x: x.open, F.concat(F.lit(template.other.open), escape(t["role"], template), F.lit(template.mark)))
        closed = _look(t["role"], template, lambda x: x.close, F.lit(template.other.close))
        loss = _look(t["role"], template, lambda x: x.loss, F.lit(template.other.loss))
        return F.array(*(F.struct(a.alias("text"), b.alias("loss")) for a, b in ((opened, F.lit(False)), (escape(t["text"], template), loss), (closed, F.lit(False)))))

    began = F.struct(F.lit("start").alias("state"), F.lit(None).cast("int").alias("wrong"), F.lit(0).alias("at"))
    start = F.array(F.struct(F.lit(template.start).alias("text"), F.lit(False).alias("loss")))
    out = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.aggregate("turns", began, step).alias("end"), F.concat(start, F.flatten(F.transform("turns", render))).alias("segments"))
    ended = F.col("end.state").isin(*template.final)
    wrong = F.when(F.col("end.wrong").isNotNull(), F.col("end.wrong")).when(~ended, F.col("end.at"))
    return out.select("conv_id", "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), wrong.isNull().alias("valid"), wrong.alias("wrong_turn"))


def parse(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns (array of struct role, text) read back from a rendered conversation."""
    opens = "|".join(_quote(t.open) for t in (*template.roles.values(), template.other))
    body = F.substring(formatted, F.lit(len(template.start) + 1), F.length(formatted))
    pieces = F.filter(F.split(body, f"(?={opens})"), lambda p: p != "")

    def inner(p: Column, turn: Turn) -> Column:
        return F.substring(p, F.lit(len(turn.open) + 1), F.length(p) - len(turn.open) - len(turn.close))

    def read(p: Column) -> Column:
        own = inner(p, template.other)
        role, text = F.substring_index(own, template.mark, 1), None
        text = F.substring(own, F.length(role) + len(template.mark) + 1, F.length(own))
        out = F.struct(unescape(role).alias("role"), unescape(text).alias("text"))
        for name, turn in template.roles.items():
            out = F.when(p.startswith(turn.open), F.struct(F.lit(name).alias("role"), unescape(inner(p, turn)).alias("text"))).otherwise(out)
        return out

    return F.transform(pieces, read)


#: A conversation whose texts are full of control strings.
PROBE = (-7, (("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(t).alias("text")) for k, (r, t) in enumerate(PROBE[1]))))
    probe = spark.range(1).select(F.lit(PROBE[0]).cast("long").alias("conv_id"), turns.alias("t")).select("conv_id", "t.*")
    out = format_chat(rows.unionByName(probe))
    told = F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    out = out.select("conv_id", "valid", "wrong_turn", "formatted", told.alias("told"), F.array_join(learnt, "").alias("learnt"))
    return out.select(
        "conv_id",
        F.size("told").cast("long").alias("n_turns"),
        F.sha2(F.array_join("told", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def _sql() -> str:
    """The digests straight from the rows, and the rendered length from the rule of the template."""
    t = INSTRUCT
    heads = "|".join(f"{_quote(c[0])}{_quote(c[1:])}" for c in t.control)
    added = f"(length(text) + length(text) - length(replace(text, '\\', '')) + len(regexp_extract_all(text, '{heads}')))"
    role_added = added.replace("text", "role")
    marks = " ".join(f"WHEN '{n}' THEN {len(x.open) + len(x.close)}" for n, x in t.roles.items())
    loss = ", ".join(f"'{n}'" for n, x in t.roles.items() if x.loss)
    probe = ", ".join(f"({PROBE[0]}, {k}, '{r}', '{x}')" for k, (r, x) in enumerate(PROBE[1]))
    pairs = ", ".join(f"'{a}\n{b}'" for a, b in t.machine)
    return f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES {probe}) p(conv_id, turn, role, text)),
o AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, concat(coalesce(before, 'start'), chr(10), role) IN ({pairs}) AND (after IS NOT NULL OR role IN ({", ".join(f"'{x}'" for x in sorted(t.final))})) AS fine,
    {added} + CASE role {marks} ELSE {len(t.other.open) + len(t.other.close) + len(t.mark)} + {role_added} END AS wide FROM o)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role IN ({loss})), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role IN ({loss})), '')) AS loss_sha256,
    ({len(t.start)} + sum(wide))::BIGINT AS formatted_chars, bool_and(fine) AS valid
FROM c GROUP BY conv_id"""


ORACLE_SQL = _sql()
