"""Repairing the structure of conversations by a persistent audit DP.

A well-formed conversation has the role initials ``(s?(ua)+)?``. The cheapest edits that reach it are found by
a forward dynamic programme over (row, grammar state). Every state holds its cost and its audit, the
initials of the edits so far. Audits share their prefixes: an audit is a node that links to the
audit it extends, with its binary-lifting ancestors and a rolling hash. Two audits of equal cost are
compared by searching their longest common prefix over the ancestors; where hashes agree but the nodes differ, the
strings themselves are compared, so a collision cannot decide.

How long conversations are spread:

* Rows are numbered by a range sort on (conversation, turn), and the programme runs on blocks of
  neighbouring rows: for each state in which a block may start, the cheapest audit to each state
  in which it may end. Inserted turns belong to the block of the row behind them, so the last edit in
  a block's audit uses up its last row and no audit of a block is a prefix of another one.
  That is why blocks can be chosen from their costs and the order of their audits alone.
* A conversation is put together from a few numbers per block. Only its audit and its digest, which are one
  string and one SHA-256 by nature, are made in one place: the first from block audits, the second from a stream of
  rows sorted on disk, of which no more than one Arrow batch is held.
"""

import hashlib
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gazette.llm.registry import query, table
from gazette.plans.store import materialise

BLOCK_BITS = 10  # rows of a block: 2 ** 10 at most

# fixed values of the task: costs of the edits and the addition for a truncated row that stays
_REROLE, _DELETE, _INSERT, _TRUNCATED = 1, 2, 5, 5
# grammar states: nothing yet, after the system turn, after a user, after an assistant (both 0 and 3 may end)
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_KEEP = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
_SPOKEN = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}  # by a rerole or an insertion
_ROLES = {_USER: "user", _ASSISTANT: "assistant"}

_MODULUS, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E681


class Audits:
    """Strings of edits as linked nodes that share their prefixes. Node 0 is the empty string."""

    def __init__(self, modulus: int = _MODULUS):
        self.modulus = modulus
        self.edit = [""]
        self.depth = [0]
        self.hash = [0]
        self.above = [()]  # ancestors 1, 2, 4, ... steps up

    def add(self, node: int, edit: str) -> int:
        """The string of ``node`` followed by ``edit``."""
        above, step, k = [node], node, 0
        while k < len(self.above[step]):
            step = self.above[step][k]
            above.append(step)
            k += 1
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(edit)) % self.modulus)
        self.above.append(tuple(above))
        return len(self.edit) - 1

    def prefix(self, node: int, depth: int) -> int:
        """The ancestor that holds the first ``depth`` edits."""
        up = self.depth[node] - depth
        k = 0
        while up:
            if up & 1:
                node = self.above[node][k]
            up >>= 1
            k += 1
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.above[node][0]
        return "".join(reversed(out))

    def _first_difference(self, a: int, b: int) -> tuple[int, int] | None:
        """The first nodes of two equally long strings whose edits differ; None if the strings are equal."""
        if self.hash[a] == self.hash[b]:
            low = None
        else:
            # descend to the two nodes right above the longest prefixes with equal hashes
            for k in reversed(range(len(self.above[a]))):
                if k < len(self.above[a]) and self.hash[self.above[a][k]] != self.hash[self.above[b][k]]:
                    a, b = self.above[a][k], self.above[b][k]
            low = (a, b) if self.edit[a] != self.edit[b] else None
            a, b = self.above[a][0], self.above[b][0]
        # nodes are shared, so equal strings are one node; two nodes with one hash may be a collision
        while a != b:
            if self.edit[a] != self.edit[b]:
                low = (a, b)
            a, b = self.above[a][0], self.above[b][0]
        return low

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` comes before that of ``b``."""
        if a == b:
            return False
        n = min(self.depth[a], self.depth[b])
        differ = self._first_difference(self.prefix(a, n), self.prefix(b, n))
        if differ is None:
            return self.depth[a] < self.depth[b]
        return self.edit[differ[0]] < self.edit[differ[1]]


def _better(audits: Audits, held: dict, state: int, cost: int, node: int, edit: str) -> None:
    """Put the audit ``node + edit`` of this cost into ``held[state]`` if it is the better one."""
    if state in held:
        best, other = held[state]
        if cost > best:
            return
        new = audits.add(node, edit)
        if cost == best and not audits.less(new, other):
            return
        held[state] = cost, new
    else:
        held[state] = cost, audits.add(node, edit)


def _with_insertions(audits: Audits, base: dict) -> dict:
    """``base`` and what is reached from it by up to two inserted turns; more than two never gain."""
    out, last = dict(base), base
    for _ in range(2):
        grown = {}
        for state, (cost, node) in last.items():
            _better(audits, grown, _SPOKEN[state], cost + _INSERT, node, "I")
        for state, (cost, node) in grown.items():
            if state not in out or cost < out[state][0] or (cost == out[state][0] and audits.less(node, out[state][1])):
                out[state] = cost, node
        last = grown
    return out


def block_audits(rows: list[tuple[str, bool, bool]], entry: int = _START, modulus: int = _MODULUS) -> dict[int, tuple[int, str]]:
    """The cheapest cost and audit from state ``entry`` to each state behind the last row.

    ``rows`` are (role initial, must be deleted, truncated). Turns are inserted before rows only.
    """
    audits = Audits(modulus)
    base = {entry: (0, 0)}
    for initial, doomed, truncated in rows:
        after: dict[int, tuple[int, int]] = {}
        stays = _TRUNCATED if truncated else 0
        for state, (cost, node) in _with_insertions(audits, base).items():
            _better(audits, after, state, cost + _DELETE, node, "D")
            if not doomed:
                if (state, initial) in _KEEP:
                    _better(audits, after, _KEEP[state, initial], cost + stays, node, "K")
                _better(audits, after, _SPOKEN[state], cost + _REROLE + stays, node, "R")
        base = after
    return {state: (cost, audits.text(node)) for state, (cost, node) in base.items()}


def closing(state: int) -> tuple[int, str]:
    """Cost and audit of the turns to insert behind the last row."""
    missing = {_START: 0, _SYSTEM: 2, _USER: 1, _ASSISTANT: 0}[state]
    return missing * _INSERT, "I" * missing


def spoken_roles(audit: str, initials: list[str], entry: int) -> tuple[list[tuple[list[str], str]], list[str]]:
    """Per row, the roles inserted before it and its new role (``=`` kept, ``-`` deleted); then roles behind the last."""
    out, before, state, row = [], [], entry, 0
    for edit in audit:
        if edit == "I":
            state = _SPOKEN[state]
            before.append(_ROLES[state])
            continue
        if edit == "K":
            state, role = _KEEP[state, initials[row]], "="
        elif edit == "R":
            state = _SPOKEN[state]
            role = _ROLES[state]
        else:
            role = "-"
        out.append((before, role))
        before, row = [], row + 1
    return out, before


# --- jobs ------------------------------------------------------------------------------------

_BLANKS = " \t\n\v\f\r"


def damaged(conversations: DataFrame, kind: Column | None = None) -> DataFrame:
    """``conversations`` (``conv_id, turn, role, text``) with faults put in, for trials of the repair.

    ``kind`` chooses per row: 0 drops it, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 sets role user;
    by default ``crc32('conv_id:turn') % 20``. Nulls count as one space, also as role and text.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    chosen = F.crc32(key.cast("binary")) % 20 if kind is None else kind
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), chosen.alias("kind")
    )
    return rows.filter("kind <> 0 OR kind IS NULL").select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _numbered(rows: DataFrame) -> DataFrame:
    """``nr``, rising within each conversation in the order of its rows, and the ``block`` of each row.

    Rows with one (conversation, turn) stay together and are ordered by role and text; a long conversation is
    spread over range partitions. Storing fixes the numbers.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        rows.repartitionByRange(parts, "conv_id", "turn")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .withColumn("nr", F.monotonically_increasing_id())
    )
    return materialise(placed.withColumn("block", F.shiftright("nr", BLOCK_BITS)))


def _faults(numbered: DataFrame) -> DataFrame:
    """``conv_id, nr, block, initial, fault``: 0 none, 1 blank, 2 duplicate, 3 truncated. No texts."""
    ink = F.rtrim("text", F.lit(_BLANKS))
    narrow = numbered.select(
        "conv_id", "nr", "block", F.substring("role", 1, 1).alias("initial"),
        (ink == "").alias("blank"),
        (~F.right(ink, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256).alias("said"),
    )
    # combined on the map side; a text that very many rows repeat is one row here
    firsts = narrow.filter("NOT blank").groupBy("conv_id", "said").agg(F.min("nr").alias("nr")).select("nr", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    return narrow.drop("said").join(firsts, "nr", "left").select("conv_id", "nr", "block", "initial", fault.alias("fault"))


_PATHS = "array<struct<entry: int, exit: int, cost: long, audit: string>>"
_PATH_TYPE = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _block_paths(faults: DataFrame) -> DataFrame:
    """Per block of a conversation: ``conv_id, block, rows`` in order and ``paths`` from every entry to every exit."""
    blocks = faults.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("nr", "initial", "fault"))).alias("rows"))
    first = faults.groupBy(F.col("conv_id").alias("c")).agg(F.min("block").alias("b"))
    marked = blocks.join(first, blocks["conv_id"].eqNullSafe(first["c"])).select("conv_id", "block", "rows", (F.col("block") == F.col("b")).alias("opens"))

    def run(batches):
        for batch in (whole.slice(at, 64) for whole in batches for at in range(0, whole.num_rows, 64)):
            found = []
            for rows, opens in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                plain = [(r["initial"], r["fault"] in (1, 2), r["fault"] == 3) for r in rows]
                paths = []
                for entry in (_START,) if opens else range(4):
                    for state, (cost, audit) in block_audits(plain, entry).items():
                        paths.append({"entry": entry, "exit": state, "cost": cost, "audit": audit})
                found.append(paths)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, _PATH_TYPE)], names=["conv_id", "block", "rows", "paths"])

    kind = faults.schema["conv_id"].dataType.simpleString()
    return marked.mapInArrow(run, f"conv_id {kind}, block long, rows array<struct<nr: long, initial: string, fault: int>>, paths {_PATHS}")


def choose_paths(blocks: list[dict[tuple[int, int], tuple[int, int]]]) -> tuple[int, list[tuple[int, int]]]:
    """Total cost and the (entry, exit) of each block, from (entry, exit) -> (cost, place of the audit in order)."""
    ahead = {state: closing(state)[0] for state in range(4)}
    to_end = [ahead]
    for paths in reversed(blocks):
        here: dict[int, int] = {}
        for (entry, state), (cost, _) in paths.items():
            if state in ahead:
                here[entry] = min(here.get(entry, cost + ahead[state]), cost + ahead[state])
        to_end.append(ahead := here)
    to_end.reverse()
    state, chosen = _START, []
    for i, paths in enumerate(blocks):
        best = min((cost + to_end[i + 1][after], place, after) for (entry, after), (cost, place) in paths.items() if entry == state)
        chosen.append((state, best[2]))
        state = best[2]
    return to_end[0].get(_START, 0), chosen


def _choices(paths: DataFrame) -> DataFrame:
    """``conv_id, block, entry, exit, total`` of the cheapest audit. Per block it gathers some 16 small numbers."""
    place = F.transform("paths", lambda p: F.size(F.filter("paths", lambda q: (q["entry"] == p["entry"]) & (q["audit"] < p["audit"]))))
    small = F.zip_with("paths", place, lambda p, at: F.struct(p["entry"].alias("entry"), p["exit"].alias("exit"), p["cost"].alias("cost"), at.alias("place")))
    whole = paths.select("conv_id", F.struct("block", small.alias("ways")).alias("b")).groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("blocks"))
    out = pa.list_(pa.struct([("block", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32())]))

    def run(batches):
        for batch in batches:
            totals, chosen = [], []
            for blocks in batch.column(1).to_pylist():
                total, steps = choose_paths([{(w["entry"], w["exit"]): (w["cost"], w["place"]) for w in b["ways"]} for b in blocks])
                totals.append(total)
                chosen.append([{"block": b["block"], "entry": s, "exit": t} for b, (s, t) in zip(blocks, steps, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(chosen, out)], names=["conv_id", "total", "chosen"])

    kind = paths.schema["conv_id"].dataType.simpleString()
    done = whole.mapInArrow(run, f"conv_id {kind}, total long, chosen array<struct<block: long, entry: int, exit: int>>")
    return done.select("conv_id", "total", F.size("chosen").alias("n_blocks"), F.posexplode("chosen").alias("at", "c")).select(
        "conv_id", "total", (F.col("at") == F.col("n_blocks") - 1).alias("closes"), "c.*"
    )


def _row_edits(chosen: DataFrame) -> DataFrame:
    """``nr, before, role, behind`` per row: roles inserted before it, its own role, roles inserted behind the last row."""

    def run(batches):
        for batch in (whole.slice(at, 64) for whole in batches for at in range(0, whole.num_rows, 64)):
            nr, before, roles, behind = [], [], [], []
            for rows, audit, entry, tail in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                edits, _ = spoken_roles(audit, [r["initial"] for r in rows], entry)
                nr += [r["nr"] for r in rows]
                before += [e[0] for e in edits]
                roles += [e[1] for e in edits]
                behind += [[]] * (len(rows) - 1) + [tail]
            names = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(nr, pa.int64()), pa.array(before, names), pa.array(roles, pa.string()), pa.array(behind, names)],
                names=["nr", "before", "new_role", "behind"],
            )

    tail = F.when(~F.col("closes"), F.array().cast("array<string>")).when(F.col("exit") == _USER, F.array(F.lit("assistant")))
    tail = tail.when(F.col("exit") == _SYSTEM, F.array(F.lit("user"), F.lit("assistant"))).otherwise(F.array().cast("array<string>"))
    return chosen.select("rows", "audit", "entry", tail.alias("tail")).mapInArrow(
        run, "nr long, before array<string>, new_role string, behind array<string>"
    )


def repaired_turns(numbered: DataFrame, edits: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: ``conv_id, nr, place, role, text``, in order of ``nr, place``."""
    own = F.when(F.col("new_role") == "=", F.col("role")).when(F.col("new_role") != "-", F.col("new_role"))
    empty = F.lit("")
    added = lambda c: F.transform(c, lambda r: F.struct(r.alias("role"), empty.alias("text")))
    said = F.filter(F.array(F.struct(own.alias("role"), F.col("text").alias("text"))), lambda t: t["role"].isNotNull())
    turns = F.concat(added("before"), said, added("behind"))
    return numbered.join(edits, "nr").select("conv_id", "nr", F.posexplode(turns).alias("place", "turn")).select("conv_id", "nr", "place", "turn.*")


def _digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` from a stream of sorted turns; a conversation is hashed as it passes."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "nr", "place")

    def run(batches):
        key = running = None
        make = lambda k, h: pa.RecordBatch.from_arrays([pa.array(k, arrow), pa.array(h, pa.string())], names=["conv_id", "repaired_sha256"])
        for batch in batches:
            arrow, done, hashes = batch.schema.field(0).type, [], []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                if running is None or conv != key:
                    if running is not None:
                        done.append(key)
                        hashes.append(running.hexdigest())
                    key, running = conv, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
            if done:
                yield make(done, hashes)
        if running is not None:
            yield make([key], [running.hexdigest()])

    return ordered.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The audits of all conversations in ``rows`` (``conv_id, turn, role, text``), and their repaired turns.

    The first table has ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``. Rows are
    taken by turn (nulls first), those of one turn by role and text. Repeated rows are duplicates, a null
    ``conv_id`` is a conversation of its own, and nulls in role or text count as one space. A role whose initial is not
    s, u or a (or that is empty) can only be reroled or deleted. An empty table gives no rows; other columns are not read.
    """
    space = F.lit(" ")
    plain = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    numbered = _numbered(plain)
    faults = materialise(_faults(numbered))
    paths = materialise(_block_paths(faults))
    choices = materialise(_choices(paths.select("conv_id", "block", "paths")))
    one = F.element_at(F.filter("paths", lambda p: (p["entry"] == F.col("entry")) & (p["exit"] == F.col("exit"))), 1)
    picked = choices.withColumnRenamed("conv_id", "c").join(paths.withColumnRenamed("block", "b"), F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("block") == F.col("b")))
    chosen = materialise(picked.select("conv_id", "block", "rows", "entry", "exit", "closes", "total", one["audit"].alias("audit")))
    turns = repaired_turns(numbered, _row_edits(chosen))

    tail = F.when(F.col("closes"), F.repeat(F.lit("I"), F.when(F.col("exit") == _SYSTEM, 2).when(F.col("exit") == _USER, 1).otherwise(0))).otherwise("")
    audits = chosen.groupBy("conv_id").agg(
        F.max("total").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", F.concat("audit", tail).alias("audit")))), lambda b: b["audit"]), "").alias("audit"),
    )
    span = F.max("turn") - F.min("turn") + 1
    # distinct turns are combined on the map side, so a long conversation does not meet in one task
    each = numbered.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).groupBy("conv_id").agg(
        F.coalesce(span - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    kinds = [F.coalesce(F.sum((F.col("fault") == k).cast("long")), F.lit(0)).alias(name) for k, name in ((1, "blank"), (2, "duplicate"), (3, "truncated"))]
    # pairs of neighbours inside blocks, and the pairs across their edges from one row per block
    allowed = F.array(*[F.lit(x) for x in ("su", "ua", "au")])
    initials = F.transform("rows", lambda r: r["initial"])
    pairs = F.size(initials) - 1
    inner = F.zip_with(F.slice(initials, F.lit(1), pairs), F.slice(initials, F.lit(2), pairs), lambda a, b: F.concat(a, b))
    wrong = lambda a: F.size(F.filter(a, lambda p: ~F.array_contains(allowed, p)))
    edge = F.struct("block", initials[0].alias("first"), F.element_at(initials, -1).alias("last"))
    edges = paths.groupBy("conv_id").agg(F.sum(wrong(inner)).alias("inside"), F.array_sort(F.collect_list(edge)).alias("edges"))
    n = F.size("edges") - 1
    across = F.zip_with(F.slice("edges", F.lit(1), n), F.slice("edges", F.lit(2), n), lambda a, b: F.concat(a["last"], b["first"]))
    illegal = edges.select("conv_id", (F.col("inside") + wrong(across)).cast("long").alias("illegal"))
    out = audits
    for side in (each, faults.groupBy("conv_id").agg(*kinds), illegal, _digests(turns)):
        other = side.withColumnRenamed("conv_id", "c")
        out = out.join(other, F.col("c").eqNullSafe(F.col("conv_id")), "left").drop("c")
    digest = F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return out.select(*names, digest.alias("repaired_sha256")), turns


def every_conversation(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    """``audits`` with a row of zeros for each conversation that has no rows left."""
    ids = conversations.select(F.col("conv_id").alias("c")).distinct()
    joined = ids.join(audits, F.col("c").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("c", "conv_id")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        "conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    )


def _sql() -> str:
    """The programme as a recursive query over rows: per state the least (cost, audit) of a conversation."""
    crc = (
        "xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, strlen(k) + 1),"
        " lambda i: ord(substr(k, i, 1))::BIGINT),"
        " lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))))"
    )
    # states: 0 start, 1 system, 2 user, 3 assistant; (from, to, edit, cost of the state change, initial asked for)
    rows = []
    for state, told in product(range(4), range(3)):
        at, inserted = state, told
        for _ in range(told):
            at = _SPOKEN[at]
        ins = "I" * inserted
        rows.append((state, at, ins + "D", inserted * _INSERT + _DELETE, None, "any"))
        rows += [(state, to, ins + "K", inserted * _INSERT, initial, "stays") for (was, initial), to in _KEEP.items() if was == at]
        rows.append((state, _SPOKEN[at], ins + "R", inserted * _INSERT + _REROLE, None, "stays"))
    steps = ", ".join(f"({a}, {b}, '{e}', {c}, {'NULL' if i is None else repr(i)}, '{w}')" for a, b, e, c, i, w in rows)
    ws = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    return rf"""
    WITH RECURSIVE keyed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
        FROM conversations
    ), hurt AS (SELECT *, {crc} % 20 AS kind FROM keyed),
    rows0 AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
               unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
        FROM hurt
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS nr,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
               rtrim(text, {ws}) AS ink, substr(role, 1, 1) AS initial
        FROM rows0
    ), judged AS MATERIALIZED (
        SELECT *, CASE WHEN ink = '' THEN 1 WHEN again > 1 THEN 2 WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
               lag(initial) OVER (PARTITION BY conv_id ORDER BY nr) || initial AS pair,
               max(nr) OVER (PARTITION BY conv_id) AS n_rows
        FROM placed
    ), steps(s, t, edit, cost, asked, whose) AS (VALUES {steps}),
    walk(conv_id, nr, n_rows, s, best) AS (
        SELECT DISTINCT conv_id, 0::BIGINT, n_rows, 0, {{'cost': 0::BIGINT, 'audit': ''}} FROM judged
        UNION ALL
        SELECT w.conv_id, j.nr, w.n_rows, p.t,
               min({{'cost': w.best.cost + p.cost + CASE WHEN j.fault = 3 AND p.whose = 'stays' THEN {_TRUNCATED} ELSE 0 END,
                     'audit': w.best.audit || p.edit}})
        FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.nr = w.nr + 1
             JOIN steps p ON p.s = w.s AND (p.asked IS NULL OR p.asked = j.initial) AND (p.whose = 'any' OR j.fault NOT IN (1, 2))
        GROUP BY w.conv_id, j.nr, w.n_rows, p.t
    ), ended AS (
        SELECT conv_id, min({{'cost': best.cost + CASE s WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END,
                              'audit': best.audit || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}}) AS best
        FROM walk WHERE nr = n_rows GROUP BY conv_id
    ), edits AS (
        SELECT conv_id, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS i FROM ended
    ), marks AS (
        SELECT conv_id, i, substr(audit, i, 1) AS edit,
               sum(CASE WHEN substr(audit, i, 1) <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS nr
        FROM edits
    ), said AS (
        SELECT m.conv_id, m.i, m.edit, j.role, CASE WHEN m.edit = 'I' THEN '' ELSE j.text END AS text,
               row_number() OVER (PARTITION BY m.conv_id ORDER BY m.i)
                 + CASE WHEN first_value(CASE WHEN m.edit = 'K' THEN j.initial ELSE 'u' END) OVER (PARTITION BY m.conv_id ORDER BY m.i) = 's' THEN 1 ELSE 0 END AS place
        FROM marks m LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM m.conv_id AND j.nr = m.nr AND m.edit <> 'I'
        WHERE m.edit <> 'D'
    ), digests AS (
        SELECT conv_id, sha256(string_agg((CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY i)) AS h
        FROM said GROUP BY conv_id
    ), counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
               count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
               count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
        FROM judged GROUP BY conv_id
    )
    SELECT ids.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
           coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(e.best.cost, 0) AS cost,
           coalesce(e.best.audit, '') AS audit, coalesce(d.h, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) ids
    LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id
    LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id
    LEFT JOIN digests d ON d.conv_id IS NOT DISTINCT FROM ids.conv_id
    """


@query(sql=_sql())
def op13_repair(spark, sf_dir):
    """Damages all ``conversations`` and audits the repair of each."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    audits, _ = repair(damaged(conversations))
    return every_conversation(conversations, audits)
