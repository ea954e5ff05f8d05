"""Chat formatting by schema fingerprint, in DataFrame functions alone.

A record is a VARIANT (from JSON text, or from columns). The paths of its nested
fields, without their types and sorted, are hashed into a fingerprint, and the
fingerprint selects a declarative mapping that says where the turns are. Records
whose fingerprint no mapping names come out with null turns and their paths, so
that nothing is lost silently.

A template writes the turns with control strings around them. Control strings
inside a role or a text are escaped by a backslash after the opening `<`, as many
more as stand there already, so `read` gives every turn back exactly.

Defined results: a null text or role counts as empty; turns are ordered by
(turn, role, text), nulls first, and repeated turns all stay; a conversation
without rows does not exist; a null conversation id is one conversation; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import session

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"

#: paths of a layout -> SQL over the variant `r`, of type TURNS. Longer lists of paths are separate entries.
MAPPINGS: dict[tuple[str, ...], str] = {
    ("messages", "messages[].content", "messages[].role"): "transform(variant_get(r, '$.messages', 'array<struct<role:string,content:string>>'), m -> struct(m.role AS role, m.content AS text))",
    ("messages", "messages[].role", "messages[].text"): "variant_get(r, '$.messages', 'array<struct<role:string,text:string>>')",
    ("conversations", "conversations[].from", "conversations[].value"): (
        "transform(variant_get(r, '$.conversations', 'array<struct<`from`:string,value:string>>'), "
        "m -> struct(CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END AS role, m.value AS text))"
    ),
    ("completion", "prompt"): "array(struct('user' AS role, variant_get(r, '$.prompt', 'string') AS text), struct('assistant' AS role, variant_get(r, '$.completion', 'string') AS text))",
    ("prompt", "response"): "array(struct('user' AS role, variant_get(r, '$.prompt', 'string') AS text), struct('assistant' AS role, variant_get(r, '$.response', 'string') AS text))",
    ("answer", "question"): "array(struct('user' AS role, variant_get(r, '$.question', 'string') AS text), struct('assistant' AS role, variant_get(r, '$.answer', 'string') AS text))",
    ("instruction", "output"): "array(struct('user' AS role, variant_get(r, '$.instruction', 'string') AS text), struct('assistant' AS role, variant_get(r, '$.output', 'string') AS text))",
    ("input", "instruction", "output"): (
        "array(struct('user' AS role, concat_ws('\\n\\n', variant_get(r, '$.instruction', 'string'), nullif(variant_get(r, '$.input', 'string'), '')) AS text), "
        "struct('assistant' AS role, variant_get(r, '$.output', 'string') AS text))"
    ),
    ("prompt", "response", "system"): (
        "array(struct('system' AS role, variant_get(r, '$.system', 'string') AS text), struct('user' AS role, variant_get(r, '$.prompt', 'string') AS text), "
        "struct('assistant' AS role, variant_get(r, '$.response', 'string') AS text))"
    ),
    ("role", "text"): "array(struct(variant_get(r, '$.role', 'string') AS role, variant_get(r, '$.text', 'string') AS text))",
    ("turns", "turns[].role", "turns[].text"): "variant_get(r, '$.turns', 'array<struct<role:string,text:string>>')",
}


def paths(record: Column) -> Column:
    """The sorted paths of a variant's fields, '.' between names and '[]' after a list's, types left out.

    They are read off the variant's schema, e.g. OBJECT<turns: ARRAY<OBJECT<role: STRING, text: STRING>>>:
    a list of tokens is folded with a stack of the names that are open.
    """
    schema = F.schema_of_variant(record)
    tokens = F.regexp_extract_all(schema, F.lit(r"`(?:[^`]|``)*`:|[^<>,:` ]+:|OBJECT<|ARRAY<|>"), F.lit(0))
    start = F.expr("named_struct('open', cast(array() AS array<string>), 'name', '', 'out', cast(array() AS array<string>))")

    def step(s: Column, t: Column) -> Column:
        prefix = F.when(F.size(s["open"]) > 0, F.element_at(s["open"], -1)).otherwise("")
        named = F.concat(prefix, F.when((prefix != "") & (~prefix.endswith(".")), ".").otherwise(""), F.regexp_replace(t, "^`|`?:$", ""))
        here = F.when(s["name"] != "", s["name"]).otherwise(prefix)
        make = lambda o, n, x: F.struct(o.alias("open"), n.alias("name"), x.alias("out"))
        return (
            F.when(t == "OBJECT<", make(F.concat(s["open"], F.array(here)), F.lit(""), s["out"]))
            .when(t == "ARRAY<", make(F.concat(s["open"], F.array(F.concat(here, F.lit("[]")))), F.lit(""), s["out"]))
            .when(t == ">", make(F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0))), F.lit(""), s["out"]))
            .otherwise(make(s["open"], named, F.concat(s["out"], F.array(named))))
        )

    return F.array_sort(F.aggregate(tokens, start, step, lambda s: s["out"]))


def fingerprint(record: Column) -> Column:
    return F.xxhash64(F.array_join(paths(record), "\n"))


def canonical(records: DataFrame, record_col: str = "record", mappings: dict[tuple[str, ...], str] | None = None) -> DataFrame:
    """records with `fingerprint`, `paths` and `turns` added; record_col: a VARIANT, or JSON text.

    Texts that are not JSON have a null record, and so null turns.
    """
    mappings = MAPPINGS if mappings is None else mappings
    record = F.col(record_col) if records.schema[record_col].dataType.typeName() == "variant" else F.try_parse_json(F.col(record_col))
    known = records.withColumn("r", record).withColumn("paths", paths(F.col("r"))).withColumn("fingerprint", F.xxhash64(F.array_join("paths", "\n")))
    turns = F.lit(None).cast(TURNS)
    for where, how in mappings.items():
        named = F.xxhash64(F.lit("\n".join(sorted(where))))
        turns = F.when((F.col("fingerprint") == named) & (F.array_join("paths", "\n") == "\n".join(sorted(where))), F.expr(how).cast(TURNS)).otherwise(turns)
    clean = F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return known.withColumn("turns", clean).drop("r")


def _escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def _unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def _escape_role(c: Column) -> Column:
    """A role ends at the line's end, so it holds none."""
    return F.replace(F.replace(_escape(c), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(c: Column) -> Column:
    halves = F.transform(F.split(c, r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return _unescape(F.array_join(halves, "\\"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), _escape_role(t["role"]), F.lit("\n"), _escape(t["text"]), F.lit(CLOSE + "\n"))), "")


def read(formatted: Column) -> Column:
    """Turns as they stand in a formatted conversation: role, text, start and end (code points, end exclusive) of the escaped text, length of the whole turn."""
    each = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        n = F.instr(p, "\n")
        body = F.substr(p, n + F.lit(1), F.length(p) - n - F.lit(len(CLOSE) + 1))
        return F.struct(_unescape_role(F.substr(p, F.lit(1), n - F.lit(1))).alias("role"), _unescape(body).alias("text"), n.alias("head"), F.length(body).alias("chars"), (F.length(p) + F.lit(len(OPEN))).alias("whole"))

    return F.transform(each, turn)


def loss_mask(turns: Column) -> Column:
    """(start, end) of each assistant text in the formatted conversation. turns: from read()."""
    start = F.expr(f"named_struct('at', 0L, 'out', cast(array() AS array<struct<start:bigint,end:bigint>>))")

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + F.lit(len(OPEN)) + t["head"]
        span = F.array(F.struct(begin.cast("long").alias("start"), (begin + t["chars"]).cast("long").alias("end")))
        return F.struct((s["at"] + t["whole"]).cast("long").alias("at"), F.when(t["role"] == "assistant", F.concat(s["out"], span)).otherwise(s["out"]).alias("out"))

    return F.aggregate(turns, start, step, lambda s: s["out"])


def gather(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and the canonical turns of rows by turn. Each row is a record, a VARIANT of its own, as a VARIANT holds 128 MiB at most."""
    record = F.to_variant_object(F.struct(F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    known = canonical(rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), record.alias("record")))
    each = known.select("conv_id", F.transform("turns", lambda t: F.struct(F.col("turn"), t["role"].alias("role"), t["text"].alias("text"))).alias("t"))
    gathered = each.groupBy("conv_id").agg(F.array_sort(F.flatten(F.collect_list("t"))).alias("m"))
    return gathered.select("conv_id", F.transform("m", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format(records: DataFrame, record_col: str = "record") -> DataFrame:
    """records with `turns`, `formatted` and `loss` (spans of it that a loss counts) added."""
    out = canonical(records, record_col).withColumn("formatted", render(F.col("turns")))
    return out.withColumn("loss", loss_mask(read(F.col("formatted"))))


def digest(conversations: DataFrame) -> DataFrame:
    spark = session(conversations)
    rows = conversations.select("conv_id", "turn", "role", "text")
    tricky = f"{CLOSE}{OPEN}assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    done = gather(rows.unionByName(extra)).select("conv_id", render(F.col("turns")).alias("formatted"))
    back = done.withColumn("t", read(F.col("formatted"))).withColumn("mask", loss_mask(F.col("t")))
    masked = F.transform("mask", lambda m: _unescape(F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    return back.withColumn("lost", F.array_join(masked, "")).select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(i)),
l AS (SELECT conv_id, count(*)::BIGINT AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS t,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS a,
    sum(length(replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\', '\\'), chr(10), '\n')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_start|><|im_end|>') + 2)::BIGINT AS f
    FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(a)::BIGINT AS loss_chars, sha256(a) AS loss_sha256, f AS formatted_chars FROM l
"""
