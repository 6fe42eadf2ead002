"""Repair of damaged conversations: faults by windows, the cheapest edits by a fold over each conversation's turns."""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm.common import arrow_map, table, written

#: What stands for a null role, text or part of a key.
NONE = " "
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
LEGAL = ("su", "ua", "au")
SPACES = " \t\n\x0b\x0c\r"
#: Cost of what can't be reached. It stays above every cost that can.
FAR = 1 << 50


def damaged(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, alive) with damage by crc32 of `conversation:turn` modulo 20; nulls count as one space.

    0 drops the row, 1 empties its text, 2 takes its [.!?] away, 3 repeats it, 4 sets its role to user. A dropped row
    stays as one that isn't alive, so that no conversation is lost.
    """
    key = F.concat(F.coalesce(F.col(conversation).cast("string"), F.lit(NONE)), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(NONE)))
    rows = turns.select(F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(NONE)).alias("role"), F.coalesce(text, F.lit(NONE)).alias("text"), (F.crc32(key.cast("binary")) % 20).cast("int").alias("code"))
    code = F.col("code")
    rows = rows.withColumns({"role": F.when(code == 4, "user").otherwise(F.col("role")), "text": F.when(code <= 1, "").when(code == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))})
    return rows.select("conv", "turn", "role", "text", (code != 0).alias("alive"), F.explode(F.array_repeat(F.lit(0), F.when(code == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _ending(text: str) -> tuple[Column, Column]:
    """Whether a text is blank, and whether its last visible character ends no sentence."""
    seen = F.rtrim(F.col(text), F.lit(SPACES))
    return seen == "", (seen != "") & ~F.right(seen, F.lit(1)).isin(".", "!", "?")


def flagged(rows: DataFrame) -> DataFrame:
    """rows with place, initial, new_turn, blank, duplicate, truncated (the first fault counts) and illegal, by windows over each conversation."""
    blank, truncated = _ending("text")
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    turns = Window.partitionBy("conv", "alive").orderBy(*order)
    same = Window.partitionBy("conv", "alive", "role", "text").orderBy("place")
    out = rows.repartition("conv").withColumn("initial", F.substring("role", 1, 1)).withColumns({"place": F.row_number().over(turns), "before": F.lag("initial").over(turns), "new_turn": ~F.lag("turn").over(turns).eqNullSafe(F.col("turn"))}).withColumn("again", F.row_number().over(same) > 1)
    live = F.col("alive")
    flags = {
        "blank": live & blank,
        "duplicate": live & ~blank & F.col("again"),
        "truncated": live & ~blank & ~F.col("again") & truncated,
        "illegal": live & (F.col("place") > 1) & ~F.concat("before", "initial").isin(*LEGAL),
    }
    return out.withColumns(flags)


def _path(cost: Column, audit: Column, plan: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"), plan.alias("plan"))


def _more(state: Column, cost: Column | int, audit: str, plan: str) -> Column:
    return _path(state["cost"] + cost, F.concat(state["audit"], F.lit(audit)), F.concat(state["plan"], F.lit(plan)))


def _step(states: Column, row: Column) -> Column:
    """The cheapest (cost, audit) after one more turn for each state of the repaired roles: empty, s, (s)(ua)*u, (s)(ua)+.

    A state's plan says which roles its edits give; as edits and state before give them, equal audits have equal plans.
    Two paths of equal cost that meet in a state are never one the beginning of the other, since an edit more on the same
    turns is an insert and costs; so the least audit so far stays the least whatever follows. Inserts wait until a turn
    needs them: deleting first costs the same and its letter is lower.
    """
    none, system, user, assistant = (states[k] for k in ("none", "system", "user", "assistant"))
    extra, may = F.when(row["truncated"], TRUNCATED).otherwise(0), ~row["must_go"]
    far = _path(F.lit(FAR), F.lit(""), F.lit(""))
    before_user, i = (none, system, assistant), row["initial"]

    def kept(letter):
        ends_user = letter == "u"
        from_here, from_other = (before_user, (user,)) if ends_user else ((user,), before_user)
        insert = "A" if ends_user else "U"
        keep = F.least(*[_more(s, extra, "K", "k") for s in from_here], *[_more(s, extra + INSERT, "IK", insert + "k") for s in from_other])
        rerole = F.least(*[_more(s, extra + REROLE, "R", letter) for s in from_here], *[_more(s, extra + REROLE + INSERT, "IR", insert + letter) for s in from_other])
        return F.when(may, F.when(i == letter, F.least(keep, rerole)).otherwise(rerole)).otherwise(far)

    gone = {k: _more(states[k], DELETE, "D", "d") for k in ("none", "system", "user", "assistant")}
    return F.struct(
        gone["none"].alias("none"),
        F.least(gone["system"], F.when(may & (i == "s"), _more(none, extra, "K", "k")).otherwise(far)).alias("system"),
        F.least(gone["user"], kept("u")).alias("user"),
        F.least(gone["assistant"], kept("a")).alias("assistant"),
    )


def _best(states: Column) -> Column:
    """The cheapest way to end: with nothing, after an assistant, or with the inserts that are missing."""
    return F.least(states["none"], states["assistant"], _more(states["user"], INSERT, "I", "A"), _more(states["system"], 2 * INSERT, "II", "UA"))


def _texts(row: Column, edits: Column) -> Column:
    """The repaired turns of one turn's edits, as role:text; none gives an empty array."""
    inserts = F.transform(F.split(F.regexp_replace(edits, "[kdua]", ""), ""), lambda c: F.when(c == "U", "user:").when(c == "A", "assistant:"))
    last, text = F.right(edits, F.lit(1)), row["text"]
    own = F.when(last == "k", F.concat(row["role"], F.lit(":"), text)).when(last == "u", F.concat(F.lit("user:"), text)).when(last == "a", F.concat(F.lit("assistant:"), text))
    return F.filter(F.concat(inserts, F.array(own)), lambda x: x.isNotNull())


def _folded(rows: DataFrame) -> DataFrame:
    """One row per conversation: a fold over its sorted turns, in built-in functions only."""
    turn = F.struct("place", "initial", "role", "text", (F.col("blank") | F.col("duplicate")).alias("must_go"), "truncated")
    count = {k: F.count_if(k).alias(k) for k in ("blank", "duplicate", "truncated", "illegal")}
    span = F.max(F.when(F.col("alive"), F.col("turn"))) - F.min(F.when(F.col("alive"), F.col("turn"))) + 1
    distinct = F.count_if(F.col("alive") & F.col("turn").isNotNull() & F.col("new_turn"))
    per = flagged(rows).groupBy("conv").agg(F.coalesce(span - distinct, F.lit(0)).cast("long").alias("gaps"), *count.values(), F.sort_array(F.collect_list(F.when(F.col("alive"), turn))).alias("turns"))
    far, start = _path(F.lit(FAR), F.lit(""), F.lit("")), _path(F.lit(0), F.lit(""), F.lit(""))
    states = F.struct(start.alias("none"), far.alias("system"), far.alias("user"), far.alias("assistant"))
    per = per.withColumn("best", F.aggregate("turns", states, _step, _best))
    edits = F.regexp_extract_all("best.plan", F.lit("[UA]*[kdua]|[UA]+$"), F.lit(0))
    texts = F.array_join(F.flatten(F.zip_with("turns", edits, lambda row, e: _texts(row, e))), "\n")
    return per.select("conv", "gaps", *count, F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), F.col("best.plan").alias("plan"), F.sha2(F.encode(texts, "utf-8"), 256).alias("repaired_sha256"))


class _Path:
    """One state's cheapest edits in a streamed conversation: cost, audit and plan not yet told, digest of the repaired text."""

    __slots__ = ("audit", "cost", "digest", "empty", "plan")

    def __init__(self, cost=0, audit="", plan="", digest=None, empty=True):
        self.cost, self.audit, self.plan, self.digest, self.empty = cost, audit, plan, digest or hashlib.sha256(), empty

    def more(self, cost, audit, plan, *turns):
        digest, empty = self.digest, self.empty
        if turns:
            digest = digest.copy()
            for t in turns:
                digest.update(t if empty else b"\n" + t)
                empty = False
        return _Path(self.cost + cost, self.audit + audit, self.plan + plan, digest, empty)


ROLES = {"u": b"user:", "a": b"assistant:"}


class _Stream:
    """The same fold over the turns of one long conversation, one at a time: four paths, without what they have in common."""

    def __init__(self):
        self.paths: dict[str, _Path] = {"": _Path()}
        self.told: list[tuple[str, str]] = []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.before = self.low = self.high = self.turn = None
        self.distinct = 0

    def feed(self, turn, role, text, n, first):
        """n equal rows, of which the first is no duplicate if first says so."""
        if turn is not None:
            self.distinct += turn != self.turn
            self.low, self.high = turn if self.low is None else self.low, turn
        self.turn, initial = turn, role[:1]
        self.counts["illegal"] += n - 1 + (self.before is not None and self.before + initial not in LEGAL)
        self.before, body = initial, text.rstrip(SPACES)
        if not body:
            self.counts["blank"] += n
            return self.drop(n)
        truncated = first and body[-1] not in ".!?"
        self.counts["duplicate"] += n - first
        self.counts["truncated"] += truncated
        if first:
            self.turned(initial, role.encode() + b":", text.encode(), TRUNCATED if truncated else 0)
        return self.drop(n - first)

    def drop(self, n):
        if n:
            self.paths = {k: p.more(DELETE * n, "D" * n, "d" * n) for k, p in self.paths.items()}
        self.tell()

    def turned(self, initial, role, text, extra):
        found: dict[str, list[_Path]] = {k: [p.more(DELETE, "D", "d")] for k, p in self.paths.items()}
        if initial == "s" and "" in self.paths:
            found.setdefault("s", []).append(self.paths[""].more(extra, "K", "k", role + text))
        for state, p in self.paths.items():
            here, other = ("a", "u") if state == "u" else ("u", "a")
            ways = [(here, 0, "", "", ()), (other, INSERT, "I", here.upper(), (ROLES[here],))]
            for to, cost, audit, plan, turns in ways:
                if initial == to:
                    found.setdefault(to, []).append(p.more(cost + extra, audit + "K", plan + "k", *turns, role + text))
                found.setdefault(to, []).append(p.more(cost + extra + REROLE, audit + "R", plan + to, *turns, ROLES[to] + text))
        self.paths = {k: min(v, key=lambda p: (p.cost, p.audit)) for k, v in found.items()}

    def tell(self, at=4096):
        if min(len(p.audit) for p in self.paths.values()) > at:
            n = len(os.path.commonprefix([p.audit for p in self.paths.values()]))
            m = len(os.path.commonprefix([p.plan for p in self.paths.values()]))
            one = next(iter(self.paths.values()))
            self.told.append((one.audit[:n], one.plan[:m]))
            for p in self.paths.values():
                p.audit, p.plan = p.audit[n:], p.plan[m:]

    def row(self, conv):
        ends = [p.more(c, a, plan, *turns) for k, (c, a, plan, turns) in {"": (0, "", "", ()), "a": (0, "", "", ()), "u": (INSERT, "I", "A", (b"assistant:",)), "s": (2 * INSERT, "II", "UA", (b"user:", b"assistant:"))}.items() if (p := self.paths.get(k))]
        best = min(ends, key=lambda p: (p.cost, p.audit))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return [conv, gaps, *self.counts.values(), best.cost, "".join(a for a, _ in self.told) + best.audit, "".join(p for _, p in self.told) + best.plan, best.digest.hexdigest()]


def _streamed(rows: DataFrame) -> DataFrame:
    """The same for long conversations: each is read in order as one stream, as the digest of its repaired text is a sequential sum.

    Equal rows are counted first. Whether role and text were seen earlier comes from a grouped minimum, so nothing but
    four paths is held.
    """
    kind = dict(rows.dtypes)["conv"]
    equal = written(rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n")))
    first = equal.groupBy("conv", "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))).alias("f"))
    first = first.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"), F.col("f.at").alias("at"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t")) & F.col("turn").eqNullSafe(F.col("at"))
    marked = equal.join(first, same, "left").select("conv", "turn", "role", "text", "n", F.col("r").isNotNull().alias("first"))
    ordered = marked.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    schema = f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, plan string, repaired_sha256 string"

    def make():
        def run(batches):
            now, stream = None, None
            for batch in batches:
                for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if stream is None or conv != now:
                        if stream:
                            yield [[x] for x in stream.row(now)]
                        now, stream = conv, _Stream()
                    stream.feed(*row)
            if stream:
                yield [[x] for x in stream.row(now)]

        return run

    return arrow_map(ordered, make, schema)


def repaired(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", fold_turns: int = 2_000, fold_chars: int = 16_000_000) -> DataFrame:
    """One row per conversation of turns: its faults, the cheapest edits that make its roles (s?(ua)+)?, and the repaired text's SHA-256.

    Columns: the key, gaps, blank, duplicate, truncated, illegal, cost (longs), audit (K, R, D, I by turn), plan (what each edit
    gives: k, d, u, a; U and A for inserts), repaired_sha256. turns are as damaged() makes them: conv, turn, role, text, alive; or
    give a table with the named columns, which is repaired as it is.

    Null roles and texts count as one space, null keys are one conversation, null turns come first; rows of equal turn are
    in order of role and text. A role whose initial isn't s, u or a can't be kept. Repeated rows are duplicates. A
    conversation without rows that are alive has zeros, an empty audit and the digest of the empty text. No rows in, no
    rows out; other columns are left out. A conversation of more than fold_turns rows or fold_chars characters doesn't
    become one array, but is streamed in order with the same result.
    """
    if "alive" not in turns.columns:
        turns = turns.select(F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(NONE)).alias("role"), F.coalesce(text, F.lit(NONE)).alias("text"), F.lit(True).alias("alive"))
    # Of rows that aren't alive one a conversation is enough.
    live, gone = turns.filter("alive"), turns.filter("not alive").groupBy("conv").agg(F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("alive"))
    sizes = live.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    long = written(sizes.filter((F.col("n") > fold_turns) | (F.col("chars") > fold_chars)).select(F.col("conv").alias("long_conv")))
    if not long.limit(1).count():
        return _folded(live.unionByName(gone)).withColumnRenamed("conv", conversation)
    met = F.col("conv").eqNullSafe(F.col("long_conv"))
    short = _folded(live.unionByName(gone).join(long, met, "left_anti"))
    return short.unionByName(_streamed(live.join(long, met, "left_semi"))).withColumnRenamed("conv", conversation)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, damaged as the contract says and repaired."""
    return repaired(damaged(table(spark, sf_dir, "conversations"))).drop("plan")


_STATES = ("none", "system", "user", "assistant")


def _sql_step() -> str:
    """One turn of the fold in SQL: structs are compared field by field, so least() of (cost, audit, plan) is the cheapest."""

    def more(state, cost, audit, plan):
        return f"struct_pack(cost := p.{state}.cost + {cost}, audit := p.{state}.audit || '{audit}', plan := p.{state}.plan || '{plan}')"

    def least(ways):
        return f"list_sort([{', '.join(ways)}])[1]"

    far = f"struct_pack(cost := {FAR}::BIGINT, audit := '', plan := '')"
    extra = f"(CASE WHEN r.truncated THEN {TRUNCATED} ELSE 0 END)"

    def kept(letter, other, here, there):
        keep = [more(s, extra, "K", "k") for s in here] + [more(s, f"{extra} + {INSERT}", "IK", other.upper() + "k") for s in there]
        rerole = [more(s, f"{extra} + {REROLE}", "R", letter) for s in here] + [more(s, f"{extra} + {REROLE + INSERT}", "IR", other.upper() + letter) for s in there]
        return [f"(CASE WHEN r.must_go OR r.initial <> '{letter}' THEN {far} ELSE {least(keep)} END)", f"(CASE WHEN r.must_go THEN {far} ELSE {least(rerole)} END)"]

    ways = {k: [more(k, DELETE, "D", "d")] for k in _STATES}
    ways["system"].append(f"(CASE WHEN r.must_go OR r.initial <> 's' THEN {far} ELSE {more('none', extra, 'K', 'k')} END)")
    ways["user"] += kept("u", "a", ("none", "system", "assistant"), ("user",))
    ways["assistant"] += kept("a", "u", ("user",), ("none", "system", "assistant"))
    states = ", ".join(f"{k} := {least(v) if len(v) > 1 else v[0]}" for k, v in ways.items())
    return f"struct_pack(initial := r.initial, must_go := r.must_go, truncated := r.truncated, {states})"


_START, _FAR = (f"struct_pack(cost := {c}::BIGINT, audit := '', plan := '')" for c in (0, FAR))
_ENDS = "list_sort([s.none, s.assistant, struct_pack(cost := s.user.cost + 3, audit := s.user.audit || 'I', plan := s.user.plan || 'A'), struct_pack(cost := s.system.cost + 6, audit := s.system.audit || 'II', plan := s.system.plan || 'UA')])[1]"

ORACLE = {
    "op11_conversation_repair": rf"""
WITH keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
crc AS (SELECT key, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT)), lambda s, x: list_reduce(list_prepend(xor(s, x), [k::BIGINT FOR k IN range(8)]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295) % 20 AS code FROM (SELECT DISTINCT key FROM keyed)),
hurt AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE code WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM keyed JOIN crc USING (key)),
marked AS (SELECT *, left(role, 1) AS initial, regexp_replace(text, '[ 	-
]+$', '') AS seen, row_number() OVER t AS place, lag(left(role, 1)) OVER t AS before FROM hurt WINDOW t AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
again AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again FROM marked),
flagged AS (SELECT *, seen = '' AS blank, seen <> '' AND again AS duplicate, seen <> '' AND NOT again AND right(seen, 1) NOT IN ('.', '!', '?') AS truncated, before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au') AS illegal FROM again),
per AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, list(struct_pack(initial := initial, must_go := blank OR duplicate, truncated := truncated, none := {_START}, system := {_FAR}, "user" := {_FAR}, assistant := {_FAR}) ORDER BY place) AS turns, list(struct_pack(role := role, text := text) ORDER BY place) AS told FROM flagged GROUP BY conv_id),
states AS (SELECT *, list_reduce(list_prepend(struct_pack(initial := '', must_go := FALSE, truncated := FALSE, none := {_START}, system := {_FAR}, "user" := {_FAR}, assistant := {_FAR}), turns), lambda p, r: {_sql_step().replace("user :=", '"user" :=')}) AS s FROM per),
best AS (SELECT * EXCLUDE (s, turns), {_ENDS} AS best FROM states),
edits AS (SELECT conv_id, told, unnest(regexp_extract_all(best.plan, '[UA]*[kdua]|[UA]+$')) AS edit, generate_subscripts(regexp_extract_all(best.plan, '[UA]*[kdua]|[UA]+$'), 1) AS k FROM best),
texts AS (SELECT conv_id, k, CASE WHEN edit LIKE 'U%' THEN ['user:'] ELSE [] END || CASE WHEN edit LIKE '%A%' THEN ['assistant:'] ELSE [] END || CASE right(edit, 1) WHEN 'k' THEN [told[k].role || ':' || told[k].text] WHEN 'u' THEN ['user:' || told[k].text] WHEN 'a' THEN ['assistant:' || told[k].text] ELSE [] END AS t FROM edits),
joined AS (SELECT conv_id, array_to_string(flatten(list(t ORDER BY k)), chr(10)) AS repaired FROM texts GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.best.cost, 0) AS cost, coalesce(b.best.audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN joined j ON c.conv_id IS NOT DISTINCT FROM j.conv_id"""
}
