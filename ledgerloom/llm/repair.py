"""Repair of the structure of conversations by a suffix-shared automaton.

A conversation's rows become a signature, one letter for a row's role and fault. Signatures are
sorted from their ends, so that equal suffixes stand together: each distinct suffix is one node of an
acyclic automaton, visited once, depth first, and only the nodes of the present signature are held. A
node has, for each state of the role grammar, the cost to go and the edit that the best rest of the
audit begins with; the rest itself is the next node's. Of two cheapest audits the smaller one in
ASCII is taken; edits that lead on from one state differ in their letter, so that the letter decides.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a conversation whose letters are put together in one task.
CHUNK = 50_000
#: States of `(s?(ua)+)?`: nothing yet, after s, after u, after a. What each takes, and where to.
_STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ENDS = (0, 3)
_NEVER = 1 << 60
#: The role that a state asks for, which an inserted or renamed row gets, and the state after it.
_ASKED = tuple(next((r, s) for r, s in steps.items() if r in "ua") for steps in _STEPS)


def _settled(choices: list[tuple[int, str, int]]) -> tuple[tuple[int, str, int], ...]:
    """(cost, edit, next state) of each state of a node, with insertions, which stay at the node."""
    out = []
    for at in range(4):
        best, cost, state = choices[at], 0, at
        for _ in range(2):  # a third insertion only comes back to a state
            cost, state = cost + INSERT, _ASKED[state][1]
            best = min(best, (cost + choices[state][0], "I", _ASKED[at][1]))
        out.append(best)
    return tuple(out)


def _end() -> tuple:
    return _settled([(0, "", at) if at in _ENDS else (_NEVER, "", at) for at in range(4)])


def _node(letter: str, rest: tuple) -> tuple:
    """The node of a suffix, from its first letter and the node of what follows.

    Letters: a role's initial, or x for one that the grammar does not know; upper case for a
    truncated row; d for one that has to go.
    """
    choices = []
    for at in range(4):
        found = [(DELETE + rest[at][0], "D", at)]
        if letter != "d":
            more = TRUNCATED if letter.isupper() else 0
            to = _STEPS[at].get(letter.lower())
            if to is not None:
                found.append((more + rest[to][0], "K", to))
            to = _ASKED[at][1]
            found.append((more + REROLE + rest[to][0], "R", to))
        choices.append(min(found))
    return _settled(choices)


def _script(signature: str, nodes: list[tuple]) -> str:
    """The best edits: D and K for rows, U and A for rows that become user and assistant, u and a for
    inserted ones. nodes[n] is that of the last n letters."""
    out, at, left = [], 0, len(signature)
    while True:
        _, edit, to = nodes[left][at]
        if edit == "":
            return "".join(out)
        role = _ASKED[at][0]
        out.append({"I": role, "R": role.upper()}.get(edit, edit))
        at, left = to, left - (edit != "I")


def _scripts(batches):
    """Signatures come sorted by their reversed letters."""
    nodes, before = [_end()], ""
    for batch in batches:
        costs, scripts = [], []
        for reverse in batch.column("reverse").to_pylist():
            same = next((k for k, (x, y) in enumerate(zip(before, reverse)) if x != y), min(len(before), len(reverse)))
            del nodes[same + 1 :]
            for letter in reverse[same:]:
                nodes.append(_node(letter, nodes[-1]))
            before = reverse
            costs.append(nodes[-1][0][0])
            scripts.append(_script(reverse, nodes))
        yield pa.RecordBatch.from_arrays(
            [batch.column("reverse"), batch.column("_n"), pa.array(costs, pa.int64()), pa.array(scripts, pa.string())],
            names=["reverse", "_n", "cost", "script"],
        )


def repair_scripts(signatures: DataFrame) -> DataFrame:
    """(reverse, _n, cost, script) of each distinct reversed signature; _n is how often it occurs.
    A suffix that two tasks share at the border of their ranges is worked out in both."""
    n = int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = signatures.groupBy("reverse").agg(F.count("*").alias("_n"))
    ordered = distinct.repartitionByRange(n, "reverse").sortWithinPartitions("reverse")
    return ordered.mapInArrow(_scripts, "reverse string, _n long, cost long, script string")


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by crc32(`conv_id:turn`) % 20: 0 drops a row, 1
    empties its text, 2 removes its [.!?], 3 repeats it, 4 makes it the user's. Nulls are one space,
    in the hashed text too; turn and conv_id stay null."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    case = F.crc32(name.cast("binary")) % 20
    return (
        turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), case.alias("_case"))
        .filter("_case <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("_case") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("_case") == 1, "")
            .when(F.col("_case") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text"))
            .alias("text"),
            F.explode(F.when(F.col("_case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
        )
        .drop("_copy")
    )


def _placed(turns: DataFrame) -> DataFrame:
    """Rows with their place g in the order of all conversations and their letters, stored."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    rows = common.global_rank(turns.select("conv_id", "turn", "role", "text"), order, "g")
    last = F.substring(F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1), 1, 1)
    fault = F.when(last == "", "b").when(~last.isin(".", "!", "?"), "t").otherwise("k")
    return common.stored(rows.withColumn("_fault", fault).withColumn("_text", F.sha2("text", 256)))


def _signatures(rows: DataFrame) -> DataFrame:
    """A row per conversation: first (its first place), roles and faults (a letter for each row),
    reverse (the signature from its end), least and most turn, turns (distinct ones)."""
    firsts = rows.groupBy("conv_id", "role", "_text").agg(F.min("g").alias("g")).select("g", F.lit(True).alias("_first"))
    initial = F.substring("role", 1, 1)
    known = rows.select("conv_id", "turn", "g", "role", "_fault").join(firsts, "g", "left")
    fault = F.when((F.col("_fault") != "b") & F.col("_first").isNull(), "d").otherwise(F.col("_fault"))
    marked = known.select(
        "conv_id", "turn", "g", fault.alias("fault"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial")
    )
    letter = F.when(F.col("fault").isin("b", "d"), "d").when(F.col("fault") == "t", F.upper("initial")).otherwise(F.col("initial"))
    row = F.struct("g", "initial", "fault", letter.alias("letter"))

    def joined(name: str, part: str) -> Column:
        return F.array_join(F.transform(part, lambda r: r[name]), "").alias(name)

    chunks = (
        marked.withColumn("_chunk", F.floor(F.col("g") / CHUNK))
        .groupBy("conv_id", "_chunk")
        .agg(F.array_sort(F.collect_list(row)).alias("_rows"))
        .select("conv_id", "_chunk", F.col("_rows")[0]["g"].alias("g"), *(joined(c, "_rows") for c in ("initial", "fault", "letter")))
    )
    whole = chunks.groupBy("conv_id").agg(
        F.min("g").alias("first"), F.array_sort(F.collect_list(F.struct("_chunk", "initial", "fault", "letter"))).alias("_parts")
    )
    turns = marked.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id")
    spans = turns.agg(F.min("turn").alias("least"), F.max("turn").alias("most"), F.count("turn").alias("turns"))
    return whole.join(spans.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id"))).select(
        "conv_id",
        "first",
        joined("initial", "_parts").alias("roles"),
        joined("fault", "_parts").alias("faults"),
        F.reverse(joined("letter", "_parts")).alias("reverse"),
        "least",
        "most",
        "turns",
    )


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, rows): what is wrong with each conversation and its cheapest repair, and the
    repaired rows (conv_id, place, role, text), which go in order of place.

    turns has conv_id (long), turn (long), role, text; other columns are ignored, null roles and
    texts are one space. Rows are taken by turn, then role and text, nulls first; null conv_ids are
    one conversation, repeated rows are repeated turns. A role whose first character is none of s, u
    and a, or that is empty, cannot be kept. conversations has conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit. Rows are dealt by their place, so a long conversation is in
    no single task but for its letters, one byte a row, as its audit is one value.
    """
    rows = _placed(turns.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text"))))
    signatures = common.stored(_signatures(rows))
    scripts = common.stored(repair_scripts(signatures))
    talks = common.stored(common.join_spread(signatures, scripts, ["reverse"], "_n", signatures.count()))
    legal = F.regexp_count("roles", F.lit("(?=su|ua|au)"))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0))
    conversations = talks.select(
        "conv_id",
        gaps.cast("long").alias("gaps"),
        *(F.regexp_count("faults", F.lit(c)).cast("long").alias(n) for c, n in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))),
        (F.char_length("roles") - 1 - legal).cast("long").alias("illegal"),
        "cost",
        F.translate("script", "uaUA", "IIRR").alias("audit"),
    )
    # The k-th entry is what is inserted before row k, and its own edit; the last one follows on all rows.
    entries = talks.select("conv_id", "first", F.posexplode(F.regexp_extract_all("script", F.lit("[ua]*[DKUA]|[ua]+$"), F.lit(0))).alias("k", "_edits"))
    own = F.regexp_extract("_edits", "[DKUA]$", 0).alias("_own")
    entries = entries.select("conv_id", (F.col("first") + F.col("k")).alias("g"), own, F.regexp_extract("_edits", "^[ua]*", 0).alias("_new"))
    names = F.create_map(*(F.lit(x) for x in ("u", "user", "a", "assistant")))

    def made(role: Column, text: Column, step: Column) -> Column:
        return F.struct(step.cast("int").alias("step"), role.alias("role"), text.alias("text"))

    new = F.when(F.col("_new") == "", F.array()).otherwise(
        F.transform(F.split("_new", ""), lambda c, k: made(F.element_at(names, c), F.lit(""), k))
    )
    inserted = entries.filter("_new <> ''").select("conv_id", "g", F.inline(new))
    edited = rows.select("g", "role", "text").join(entries.filter("_own in ('K', 'U', 'A')"), "g")
    role = F.when(F.col("_own") == "K", F.col("role")).otherwise(F.element_at(names, F.lower("_own")))
    kept = edited.select("conv_id", "g", F.char_length("_new").alias("step"), role.alias("role"), "text")
    place = F.struct("g", "step").alias("place")
    return conversations, kept.unionByName(inserted).select("conv_id", place, "role", "text")


def _digests(batches):
    """(conv_id, sha256) of rows that come sorted by conversation and place."""
    at, digest = None, None

    def out(done):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], names=["conv_id", "sha256"])

    for batch in batches:
        done = []
        for key, line in zip(batch.column("conv_id").to_pylist(), batch.column("line"), strict=True):
            if digest is None or key != at:
                if digest is not None:
                    done.append((at, digest.hexdigest()))
                at, digest = key, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.as_py().encode("utf-8", "surrogatepass"))
        yield out(done)
    if digest is not None:
        yield out([(at, digest.hexdigest())])


def op11_repair_conversations(spark, sf_dir: str) -> DataFrame:
    """A digest is made of one conversation's lines in order, so it reads them in one task, as a
    stream; they are not held."""
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conversations, rows = repair(damaged(turns))
    lines = rows.select("conv_id", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "line")
    digests = ordered.mapInArrow(_digests, "conv_id long, sha256 string").withColumnRenamed("conv_id", "_digest_id")
    every = turns.select("conv_id").distinct()
    found = every.join(conversations.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    found = found.join(digests, F.col("conv_id").eqNullSafe(F.col("_digest_id")), "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    figures = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in figures),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", nothing).alias("repaired_sha256"),
    )


def _sql_choice(at: int) -> str:
    """The least of `cost (12 digits), audit, script` among all edits of a row from a state.

    Scripts have the letters of audits with the row's new role behind them, which does not change
    their order: from one state there is one role for each edit."""
    role, to = _ASKED[at]
    steps = " ".join(f"WHEN '{r}' THEN best[{s + 1}]" for r, s in _STEPS[at].items())

    def more(cost, edit: str, rest: str) -> str:
        return f"lpad(CAST(CAST(substr({rest}, 1, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || '{edit}' || substr({rest}, 13)"

    cost = f"CASE WHEN fault = 't' THEN {TRUNCATED} ELSE 0 END"
    keep = f"CASE WHEN fault IN ('k', 't') THEN {more(cost, 'K.', f'(CASE initial {steps} END)')} END"
    rename = f"CASE WHEN fault IN ('k', 't') THEN {more(f'{REROLE} + {cost}', f'R{role}', f'best[{to + 1}]')} END"
    return f"least({more(DELETE, 'D.', f'best[{at + 1}]')}, {keep}, {rename})"


def _sql_inserted(name: str) -> str:
    def one(at: int, inner: str) -> str:
        return f"lpad(CAST(CAST(substr({inner}, 1, 12) AS BIGINT) + {INSERT} AS VARCHAR), 12, '0') || 'I{_ASKED[at][0]}' || substr({inner}, 13)"

    out = []
    for at in range(4):
        once = _ASKED[at][1]
        twice = _ASKED[once][1]
        out.append(f"least({name}[{at + 1}], {one(at, f'{name}[{once + 1}]')}, {one(at, '(' + one(once, f'{name}[{twice + 1}]') + ')')})")
    return f"[{', '.join(out)}]"


_STUCK = "'" + "9" * 9 + "000'"
OP11_SQL = rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
crcs AS (
  SELECT name, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(name) + 1), lambda k: CAST(ascii(name[k]) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS damage
  FROM (SELECT DISTINCT name FROM named), crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM named JOIN crcs USING (name), range(2) c(copy) WHERE damage <> 0 AND (copy = 0 OR damage = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM damaged),
faults AS (
  SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial,
    CASE WHEN last = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd'
      WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault FROM placed),
best AS (
  SELECT conv_id, n + 1 AS k, {_sql_inserted(f"['000000000000', {_STUCK}, {_STUCK}, '000000000000']")} AS best
  FROM (SELECT DISTINCT conv_id, n FROM faults)
  UNION ALL
  SELECT conv_id, k, {_sql_inserted("edits")} FROM (
    SELECT f.conv_id, f.k, [{", ".join(map(_sql_choice, range(4)))}] AS edits
    FROM best b JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.k = b.k - 1)),
found AS (SELECT conv_id, CAST(substr(best[1], 1, 12) AS BIGINT) AS cost, substr(best[1], 13) AS script FROM best WHERE k = 1),
edits AS (
  SELECT conv_id, e, script[2 * e - 1] AS edit, script[2 * e] AS role,
    sum(CASE WHEN script[2 * e - 1] = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY e) AS k
  FROM found, unnest(range(1, length(script) // 2 + 1)) u(e)),
repaired AS (
  SELECT e.conv_id, string_agg(CASE e.edit WHEN 'D' THEN NULL WHEN 'I' THEN CASE e.role WHEN 'u' THEN 'user:' ELSE 'assistant:' END
    WHEN 'R' THEN CASE e.role WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text ELSE f.role || ':' || f.text END, chr(10) ORDER BY e.e) AS lines,
    string_agg(e.edit, '' ORDER BY e.e) AS audit
  FROM edits e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.k = e.k AND e.edit <> 'I' GROUP BY e.conv_id),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (bad) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial NOT IN ('su', 'ua', 'au') AS bad FROM faults) GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN found b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""
