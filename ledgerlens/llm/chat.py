"""Chat formatting by schema fingerprints, with DataFrame functions only.

Records come in several layouts: prompt and completion, instruction with input and output, or a list of messages under
other names.  A record's fingerprint is the hash of the nested field paths that it fills; it selects a declarative mapping to
canonical turns, arrays of (role, text).  Turns are written with a template whose control strings are escaped inside roles and
texts, so that the turns can be read back, with a loss mask over the assistant's texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role: string, text: string>>"
ASSISTANT = "assistant"


# ------------------------------------------------------------------ layouts

@dataclass(frozen=True)
class Fields:
    """One turn per filled field: (role, path of the text), in order."""

    turns: tuple[tuple[str, str], ...]
    optional: tuple[str, ...] = ()

    def path_sets(self) -> list[frozenset[str]]:
        sets = [frozenset()]
        for _, path in self.turns:
            sets = [s | {path} for s in sets] + (sets if path in self.optional else [])
        return [s for s in sets if s]

    def to_turns(self) -> Column:
        made = [F.when(_at(path).isNotNull(), _turn(F.lit(role), _at(path))) for role, path in self.turns]
        return F.array_compact(F.array(*made))


@dataclass(frozen=True)
class Messages:
    """One turn per element of a list; ``roles`` renames the layout's roles to canonical ones."""

    path: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()

    def path_sets(self) -> list[frozenset[str]]:
        inner = [f"{self.path}[].{self.role}", f"{self.path}[].{self.text}"]
        return [frozenset(s) for s in ([self.path], [self.path, *inner], [self.path, inner[0]], [self.path, inner[1]])]

    def to_turns(self) -> Column:
        def canonical(role: Column) -> Column:
            named = role
            for theirs, ours in self.roles:
                named = F.when(role == theirs, F.lit(ours)).otherwise(named)
            return named

        return F.transform(_at(self.path), lambda m: _turn(canonical(m[self.role]), m[self.text]))


#: Layouts by name.  A later one is taken only where no earlier one has the same field paths.
LAYOUTS: dict[str, Fields | Messages] = {
    "prompt": Fields((("system", "system"), ("user", "prompt"), (ASSISTANT, "completion")), ("system", "completion")),
    "pair": Fields((("user", "prompt"), (ASSISTANT, "response")), ("response",)),
    "question": Fields((("system", "context"), ("user", "question"), (ASSISTANT, "answer")), ("context", "answer")),
    "instruction": Fields((("system", "instruction"), ("user", "input"), (ASSISTANT, "output")), ("input", "output")),
    "messages": Messages("messages", "role", "content"),
    "nested messages": Messages("body.messages", "author", "text"),
    "conversations": Messages("conversations", "from", "value", (("human", "user"), ("gpt", ASSISTANT))),
}


def _at(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"),
                    F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _some(elements: Column, name: str) -> Column:
    return F.coalesce(F.exists(elements, lambda e: e[name].isNotNull()), F.lit(False))


def _tests(schema: T.StructType, prefix: str = "") -> list[tuple[str, Column]]:
    """(nested field path, whether a record fills it) of every field below ``schema``; list elements count together."""
    out = []
    for f in schema.fields:
        path = prefix + f.name
        if "." in f.name or "[]" in f.name:
            continue  # a name that would read as a path
        out.append((path, _at(path).isNotNull()))
        if isinstance(f.dataType, T.StructType):
            out += _tests(f.dataType, f"{path}.")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            out += [(f"{path}[].{g.name}", _some(_at(path), g.name)) for g in f.dataType.elementType.fields]
    return out


def _hash(paths: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(paths), "\n"), 256)


def fingerprint(schema: T.StructType, known: set[str]) -> Column:
    """Hash of the ``known`` nested field paths that a record fills; fields of no layout don't change it."""
    filled = [F.when(test, F.lit(path)) for path, test in _tests(schema) if path in known]
    return _hash(F.array_compact(F.array(*filled)) if filled else F.array().cast("array<string>"))


def _has(schema: T.StructType, path: str) -> bool:
    kind: T.DataType = schema
    for step in path.replace("[]", ".[]").split("."):
        if step == "[]":
            if not isinstance(kind, T.ArrayType):
                return False
            kind = kind.elementType
            continue
        if not isinstance(kind, T.StructType) or step not in kind.names:
            return False
        kind = kind[step].dataType
    return True


def canonical_turns(records: DataFrame, layouts: dict[str, Fields | Messages] | None = None) -> DataFrame:
    """``records`` with columns ``layout`` (its name) and ``turns`` (array of role and text).

    A null field counts as absent; null texts in a list of messages are empty.  Fields that no layout knows are ignored and stay in
    the result.  A record whose field paths fit no layout, also one without any, has a null layout and null turns.  Repeated records
    are answered each; no records, no rows.  Columns named layout or turns are replaced.
    """
    layouts = LAYOUTS if layouts is None else layouts
    containers = {}  # struct columns on the way to a path are filled along with it
    for lay in layouts.values():
        for s in lay.path_sets():
            for path in s:
                head = path.split("[]")[0].split(".")
                containers[path] = {".".join(head[:i]) for i in range(1, len(head))}
    known = set(containers) | {c for cs in containers.values() for c in cs}
    schema = records.schema
    print_, name, turns, seen = fingerprint(schema, known), F.lit(None).cast("string"), F.lit(None).cast(TURNS), set()
    chosen = []
    for title, lay in layouts.items():
        fits = []
        for s in lay.path_sets():
            whole = frozenset(s | {c for p in s for c in containers[p]})
            if whole not in seen and all(_has(schema, p) for p in whole):
                seen.add(whole)
                fits.append(_hash(F.array(*(F.lit(p) for p in sorted(whole)))))
        complete = isinstance(lay, Fields) or all(_has(schema, f"{lay.path}[].{f}") for f in (lay.role, lay.text))
        if fits and complete:
            absent = [] if isinstance(lay, Messages) else [p for _, p in lay.turns if not _has(schema, p)]
            usable = lay if not absent else Fields(tuple(t for t in lay.turns if t[1] not in absent), lay.optional)
            chosen.append((title, fits, usable))
    out = records.withColumn("_print", print_)
    for title, fits, lay in reversed(chosen):
        name = F.when(F.col("_print").isin(*fits), F.lit(title)).otherwise(name)
        turns = F.when(F.col("_print").isin(*fits), lay.to_turns().cast(TURNS)).otherwise(turns)
    return out.withColumns({"layout": name, "turns": turns}).drop("_print")


# ----------------------------------------------------------------- template

TURN, TEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of this and other common templates, all escaped inside roles and texts.
CONTROL = (TURN, TEXT, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    """``text`` with a backslash before every backslash and behind the first character of every control string.

    Control strings hold no backslash, so none is left in the result.
    """
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    heads = {c[0]: [re.escape(d[1:]) for d in CONTROL if d[0] == c[0]] for c in CONTROL}
    return F.regexp_replace(doubled, "|".join(f"{re.escape(h)}(?={'|'.join(rest)})" for h, rest in heads.items()), r"$0\\")


def unescape(text: Column) -> Column:
    """The text that :func:`escape` was given: a backslash stands for the character behind it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: Column) -> Column:
    """One string of all turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(TURN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END))), "")


def loss_mask(turns: Column) -> Column:
    """Whether each turn's text bears loss: the assistant's do.  One flag per turn, so also per ``END`` of the formatted string."""
    return F.transform(turns, lambda t: t["role"] == ASSISTANT)


def formatted(records: DataFrame, layouts: dict[str, Fields | Messages] | None = None) -> DataFrame:
    """:func:`canonical_turns` with the columns ``formatted`` and ``loss_mask``; both are null where no layout fits."""
    out = canonical_turns(records, layouts)
    return out.withColumns({"formatted": format_turns(F.col("turns")), "loss_mask": loss_mask(F.col("turns"))})


def _pieces(text: Column) -> Column:
    """The turns of a formatted string, still escaped."""
    ended = F.split(text, re.escape(END))
    return F.transform(F.slice(ended, 1, F.size(ended) - 1), lambda p: F.split(F.substr(p, F.lit(len(TURN) + 1)), re.escape(TEXT)))


def read_back(text: Column) -> Column:
    """The turns of a formatted string."""
    return F.transform(_pieces(text), lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def loss_spans(text: Column, mask: Column) -> Column:
    """(start, length) in code points of a formatted string's stretches under the mask."""
    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["p"][0]) + (len(TURN) + len(TEXT))
        n = F.length(p["p"][1])
        span = F.array(F.struct(begin.cast("int").alias("start"), n.cast("int").alias("length")))
        return F.struct((begin + n + len(END)).cast("int").alias("at"),
                        F.when(p["m"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))
    both = F.zip_with(_pieces(text), mask, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    return F.aggregate(both, zero, step, lambda acc: acc["spans"])


def loss_texts(text: Column, mask: Column) -> Column:
    """The unescaped texts of a formatted string that lie under the mask, in order."""
    marked = F.zip_with(_pieces(text), mask, lambda p, m: F.when(m, unescape(p[1])))
    return F.array_compact(marked)


# -------------------------------------------------------------------- query

def records_of(conversations: DataFrame) -> DataFrame:
    """One record per conversation (conv_id, then the fields of several layouts) of rows (conv_id, turn, role, text).

    Turns go by turn (null first), role and text.  A user's and an assistant's turn become prompt and completion, with a system's turn
    before them an instruction with input and output; a third of the others with the usual roles only become conversations, the rest
    messages.  Null roles and texts are empty.  A null conv_id is a conversation of its own.  A record is one row, as its formatted string
    is; conversations are the unit of work here.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"),
                                F.struct(F.col("turn").cast("long").alias("turn"), blank("role").alias("role"),
                                         blank("text").alias("text")).alias("row"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    roles = F.array_join(F.transform("rows", lambda r: r["role"]), " ")
    usual = F.forall("rows", lambda r: r["role"].isin("system", "user", ASSISTANT))
    pair, triple = roles == "user assistant", roles == "system user assistant"
    text = lambda i: F.get("rows", F.lit(i))["text"]
    theirs = lambda r: F.when(r == "user", "human").when(r == ASSISTANT, "gpt").otherwise(r)
    rest = ~pair & ~triple
    third = rest & usual & F.coalesce(F.col("conv_id") % 3 == 0, F.lit(False))
    return rows.select(
        "conv_id", F.when(pair, text(0)).alias("prompt"), F.when(pair, text(1)).alias("completion"),
        F.when(triple, text(0)).alias("instruction"), F.when(triple, text(1)).alias("input"), F.when(triple, text(2)).alias("output"),
        F.when(rest & ~third, F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("content")))
               ).alias("messages"),
        F.when(third, F.transform("rows", lambda r: F.struct(theirs(r["role"]).alias("from"), r["text"].alias("value")))
               ).alias("conversations"))


def with_control_conversation(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) and conversation -1, both of whose turns hold control strings."""
    spark = conversations.sparkSession
    own = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"),
                               F.col("text").cast("string"))
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"),
                                  F.lit("</s>[INST] ok [/INST]").alias("text"))
    return own.unionByName(extra)


def format_digests(conversations: DataFrame) -> DataFrame:
    """Every conversation through a record and the template, read back from the formatted string."""
    done = formatted(records_of(conversations))
    turns, loss = read_back(F.col("formatted")), loss_texts(F.col("formatted"), F.col("loss_mask"))
    done = done.select("conv_id", "layout", "formatted", turns.alias("read"), F.array_join(loss, "").alias("loss"))
    whole = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "layout")
