"""Repair of conversation structure by a grammar-compressed dynamic program.

Each row of a conversation is one letter: its role and its first fault. Letters of ``BLOCK`` rows form a word. Re-Pair in Spark
rounds names frequent pairs of symbols over all words; every symbol has one (min, +) transfer matrix over the states of the role
grammar ``(s?(ua)+)?``, whose entries hold the least cost and the rope of its ASCII-least audit: a pair of the ropes of the two
symbols below it, so ropes are shared. Matrices are worked out bottom-up once per symbol, and words of all conversations are
products of them.

Long conversations have many words. Cost matrices are multiplied ``FAN`` words at a time, going back they give the cheapest rest
after every word; then each word's map of states (by the least audit among the cheapest) is composed alike and gives the state it
starts in. Two different audits of the same rows are never one the prefix of the other, as each ends with the edit of the last
row, so the least audit of the whole is made of least audits of words.

A conversation of any length is numbered, cut and solved over many tasks. Only the last step passes its rows in order through one
task, because a SHA-256 is sequential; it streams them and holds the audit, which is a value of the result.

Defined results: a null role or text counts as one space, a null id or turn is one space in the checksum. Rows of one turn are taken by
the hash of their role and text, so equal rows are neighbours. An empty role is no role of the grammar (like any role that does
not begin with s, u or a), so its row is never kept as it is. Null conversation ids are one conversation. Extra columns
play no part. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripsearch.llm.ranks import numbered
from tripsearch.ship import ship
from tripsearch.storage import durable

BLOCK = 64
FAN = 64
#: Rounds of naming, and pairs named in one: at most ROUNDS * PAIRS rules, further repeats stay unnamed.
ROUNDS = 16
PAIRS = 256
SPACES = " \t\n\x0b\x0c\r"
#: Letters of rows: role (x another) whole, the same truncated, blank, duplicate.
LETTERS = "suaxSUAXbd"
#: States: nothing yet, after s, after u, after a. Where a free role leads, and the cost of a valid end.
STATES = 4
FREE = (2, 2, 3, 2)
ENDS = (0, 10, 5, 0)
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "x": {}}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 40

Rope = str | tuple
Matrix = tuple  # of STATES rows of STATES entries (cost, rope) or None


def flat(rope: Rope) -> str:
    out, stack = [], [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            stack += [top[1], top[0]]
    return "".join(out)


def _better(a: tuple | None, b: tuple | None) -> tuple | None:
    """The cheaper entry; of equal cost the one with the ASCII-least audit."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if flat(a[1]) <= flat(b[1]) else b


def letter_matrix(letter: str) -> Matrix:
    """One row: any useful number of inserted rows, then its edit."""
    out: list[list[tuple | None]] = [[None] * STATES for _ in range(STATES)]
    role, late = letter.lower(), TRUNCATED if letter.isupper() else 0
    for start in range(STATES):
        state = start
        for inserts in range(STATES - 1):
            edits = [(state, DELETE, "D")]
            if role in KEPT:
                edits.append((FREE[state], REROLE + late, "R"))
                if state in KEPT[role]:
                    edits.append((KEPT[role][state], late, "K"))
            for to, cost, edit in edits:
                out[start][to] = _better(out[start][to], (INSERT * inserts + cost, "I" * inserts + edit))
            state = FREE[state]
    return tuple(map(tuple, out))


def times(left: Matrix, right: Matrix) -> Matrix:
    def entry(i: int, j: int) -> tuple | None:
        best = None
        for k in range(STATES):
            a, b = left[i][k], right[k][j]
            if a is not None and b is not None:
                best = _better(best, (a[0] + b[0], (a[1], b[1])))
        return best

    return tuple(tuple(entry(i, j) for j in range(STATES)) for i in range(STATES))


class Grammar:
    """Named pairs, round by round, and the matrix of every symbol. The first symbols are the letters."""

    def __init__(self) -> None:
        self.rounds: list[dict[tuple[int, int], int]] = []
        self.matrices: list[Matrix] = [letter_matrix(x) for x in LETTERS]

    def add(self, pairs: list[tuple[int, int]]) -> None:
        self.rounds.append({})
        for left, right in pairs:
            self.rounds[-1][left, right] = len(self.matrices)
            self.matrices.append(times(self.matrices[left], self.matrices[right]))

    def parse(self, word: str) -> list[int]:
        symbols = [LETTERS.index(x) for x in word]
        for named in self.rounds:
            out, i = [], 0
            while i < len(symbols):
                name = named.get((symbols[i], symbols[i + 1])) if i + 1 < len(symbols) else None
                out.append(symbols[i] if name is None else name)
                i += 1 if name is None else 2
            symbols = out
        return symbols

    def matrix(self, word: str) -> Matrix:
        symbols = self.parse(word)
        found = self.matrices[symbols[0]]
        for s in symbols[1:]:
            found = times(found, self.matrices[s])
        return found

    def steps(self, word: str, rest: tuple[int, ...]) -> list[tuple[int, Rope]]:
        """By the state before: the state after and the rope of the least cheapest audit, if ``rest`` is what each state after costs."""
        out = []
        for row in self.matrix(word):
            ways = [(e[0] + rest[j], e[1], j) for j, e in enumerate(row) if e is not None]
            least = min(w[0] for w in ways)
            _, to, rope = min((flat(w[1]), w[2], w[1]) for w in ways if w[0] == least)
            out.append((to, rope))
        return out


def learn(words: DataFrame) -> Grammar:
    """Re-Pair over ``words`` (word, n), a written table of distinct words, in rounds; each names the most frequent pairs that do not overlap."""
    spark = words.sparkSession
    ship(spark)
    grammar = Grammar()
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(grammar.rounds)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Grammar()
            known.rounds = sent.value
            found: Counter[tuple[int, int]] = Counter()
            for batch in batches:
                for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    symbols = known.parse(word)
                    for pair in zip(symbols, symbols[1:]):
                        found[pair] += n
            rows = [(a, b, n) for (a, b), n in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["a", "b", "n"])

        pairs = words.select("word", "n").mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        top = pairs.filter("n > 1").orderBy(F.desc("n"), "a", "b").limit(PAIRS).collect()
        lefts, rights, chosen = set(), set(), []
        for r in top:
            if r.a not in rights and r.b not in lefts:
                chosen.append((r.a, r.b))
                lefts.add(r.a)
                rights.add(r.b)
        sent.destroy()
        if not chosen:
            break
        grammar.add(chosen)
    return grammar


def _by_word(blocks: DataFrame, grammar: Grammar, columns: list[str], name: str, kind: str, value) -> DataFrame:
    """``blocks`` with ``value(grammar, word, rest, start)`` as a column; equal rows of a task are worked out once."""
    ship(blocks.sparkSession)
    sent = blocks.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(1 << 14)
        def found(word, rest, start):
            return value(sent.value, word, rest, start)

        for batch in batches:
            given = [batch.column(n).to_pylist() if n in batch.schema.names else [None] * batch.num_rows for n in ("word", "rest", "start")]
            made = [found(w, tuple(r) if r else None, s) for w, r, s in zip(*given)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(made, made_type)], [*columns, name])

    made_type = {"array<long>": pa.list_(pa.int64()), "string": pa.string()}[kind]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.select(*columns).schema)
    return blocks.mapInArrow(run, f"{schema}, {name} {kind}")


def _costs(grammar: Grammar, word: str, rest, start) -> list[int]:
    return [NEVER if e is None else e[0] for row in grammar.matrix(word) for e in row]


def _maps(grammar: Grammar, word: str, rest, start) -> list[int]:
    return [to for to, _ in grammar.steps(word, rest)]


def _audit(grammar: Grammar, word: str, rest, start) -> str:
    return flat(grammar.steps(word, rest)[start][1])


def _product(a: Column, b: Column) -> Column:
    """(min, +) product of matrices given as STATES * STATES costs."""
    cells = F.sequence(F.lit(0), F.lit(STATES * STATES - 1))
    row, column = lambda k: F.floor(k / STATES).cast("int") * STATES, lambda k: F.pmod(k, F.lit(STATES))
    middle = F.sequence(F.lit(0), F.lit(STATES - 1))
    return F.transform(cells, lambda k: F.array_min(F.transform(middle, lambda t: F.get(a, row(k) + t) + F.get(b, t * STATES + column(k)))))


def _applied(m: Column, rest: Column) -> Column:
    """What each state before a matrix costs, if ``rest`` is what the states after cost."""
    states = F.sequence(F.lit(0), F.lit(STATES - 1))
    return F.transform(states, lambda i: F.array_min(F.transform(states, lambda j: F.get(m, i * STATES + j) + F.get(rest, j))))


def _swept(level: DataFrame, join, first: Column, carry, backward: bool) -> DataFrame:
    """``first``, carried over the blocks (conv, block, m) of each conversation, as it is when it comes to every block: (conv, block, at).

    ``join`` makes one value of two neighbours', so values are joined FAN at a time until a conversation is one; then each group
    hands down to its members what ``carry(value, at)`` makes of what came to it. ``backward`` begins with the last block.
    """
    groups: list[DataFrame] = []
    while True:
        held = durable(level.groupBy("conv", F.floor(F.col("block") / FAN).cast("long").alias("up")).agg(
            F.array_sort(F.collect_list(F.struct("block", "m"))).alias("members")), "sweep")
        groups.append(held)
        if not (held.agg(F.max("up")).first()[0] or 0):
            break
        others = F.slice("members", 2, F.greatest(F.size("members") - 1, F.lit(0)))
        m = F.aggregate(others, F.get("members", F.lit(0))["m"], lambda a, b: join(a, b["m"]))
        level = held.select("conv", F.col("up").alias("block"), m.alias("m"))
    came = groups[-1].select("conv", "up", first.alias("at"))
    for held in groups[::-1]:
        asked = held.join(came, ["conv", "up"])
        members = F.reverse("members") if backward else F.col("members")
        begin = F.struct(F.col("at").alias("at"), F.expr("cast(array() as array<struct<block: bigint, at: array<bigint>>>)").alias("out"))
        walked = F.aggregate(members, begin, lambda s, x: F.struct(
            carry(x["m"], s["at"]).alias("at"), F.concat(s["out"], F.array(F.struct(x["block"].alias("block"), s["at"].alias("at")))).alias("out")))
        came = durable(asked.select("conv", F.explode(walked["out"]).alias("o")).select("conv", F.col("o.block").alias("up"), "o.at"), "swept")
    return came.withColumnRenamed("up", "block")


def _longs(values) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def audits(blocks: DataFrame, grammar: Grammar) -> DataFrame:
    """conv, block, word, audit of ``blocks`` (conv, block, word), a written table."""
    many = blocks.filter("block > 0").select("conv").distinct()
    ends = _longs(ENDS)
    if many.isEmpty():
        asked = blocks.select("conv", "block", "word", ends.alias("rest"), F.lit(0).alias("start"))
    else:
        many = durable(many, "long")
        long = durable(blocks.join(many, "conv", "left_semi"), "blocks")
        rest = _swept(
            _by_word(long, grammar, ["conv", "block"], "m", "array<long>", _costs), _product, ends, _applied, True
        ).withColumnRenamed("at", "rest")
        known = durable(long.join(rest, ["conv", "block"]), "rests")
        # a map of states is a list, and a start one state: carrying it is a lookup
        looked = lambda a, b: F.transform(a, lambda x: F.get(b, x.cast("int")))
        start = _swept(
            _by_word(known, grammar, ["conv", "block"], "m", "array<long>", _maps), looked, _longs([0]),
            lambda m, at: F.transform(at, lambda x: F.get(m, x.cast("int"))), False,
        )
        known = known.join(start, ["conv", "block"]).withColumn("start", F.get("at", F.lit(0)).cast("int"))
        short = blocks.join(many, "conv", "left_anti").withColumns({"rest": ends, "start": F.lit(0)})
        asked = known.select(*short.columns).unionByName(short)
    return _by_word(asked, grammar, ["conv", "block", "word"], "audit", "string", _audit)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, conv_id, turn, role, text, dropped: the rows after damage by the checksum of id and turn; dropped ones without text."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hurt = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(F.col("hurt") == 1, "").when(F.col("hurt") == 2, F.regexp_replace(shown("text"), "[.!?]", "")).when(F.col("hurt") != 0, shown("text"))
    rows = conversations.select("conv_id", "turn", "role", "text", hurt.alias("hurt"))
    return rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("conv"), "conv_id", "turn",
        F.when(F.col("hurt") == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), (F.col("hurt") == 0).alias("dropped"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("hurt") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _mark() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def words_of(rows: DataFrame) -> DataFrame:
    """conv, block, word: the letters of every conversation's rows (conv, turn, role, text) in their order."""
    ended = F.rtrim("text", F.lit(SPACES))
    initial = F.left("role", F.lit(1))
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    letter = F.when(ended == "", "b").when(F.right(ended, F.lit(1)).isin(".", "!", "?"), role).otherwise(F.upper(role))
    placed, _ = numbered(durable(rows.select("conv", "turn", _mark().alias("mark"), letter.alias("letter")), "letters"), ["conv"], ["turn", "mark"])
    placed = durable(placed, "placed")
    # the earliest of equal rows, found by place, so no key holds all copies of a row
    first = placed.groupBy("conv", "mark").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("first"))
    own = F.when((F.col("letter") == "b") | F.col("first"), F.col("letter")).otherwise("d")
    named = placed.join(first, ["conv", "pos"], "left").select("conv", "pos", own.alias("letter"))
    block = F.floor(F.col("pos") / BLOCK).cast("long").alias("block")
    letters = F.array_sort(F.collect_list(F.struct("pos", "letter")))
    return named.groupBy("conv", block).agg(F.array_join(F.transform(letters, lambda x: x["letter"]), "").alias("word"))


_REPAIRED = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_rows long"
)


class _Conversation:
    """One conversation as its audit and then its rows come by."""

    def __init__(self, key: str, conv_id) -> None:
        self.key, self.conv_id = key, conv_id
        self.words: list[str] = []
        self.pieces: list[str] = []
        self.audit, self.at, self.row, self.state = None, 0, 0, 0
        self.cost, self.illegal, self.turns, self.before = 0, 0, [], None
        self.distinct, self.sha, self.some = 0, hashlib.sha256(), False

    def say(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
        self.some = True

    def insert(self) -> None:
        self.state, self.cost, self.at = FREE[self.state], self.cost + INSERT, self.at + 1
        self.say("user" if self.state == 2 else "assistant", "")

    def start(self) -> None:
        if self.audit is None:
            self.audit, self.letters = "".join(self.pieces), "".join(self.words)

    def see(self, turn, role: str, text: str) -> None:
        self.start()
        if turn is not None:
            if not self.turns:
                self.turns, self.distinct = [turn, turn], 1
            elif turn != self.turns[1]:
                self.turns[1], self.distinct = turn, self.distinct + 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        while self.audit[self.at] == "I":
            self.insert()
        edit, letter = self.audit[self.at], self.letters[self.row]
        self.at, self.row = self.at + 1, self.row + 1
        if edit == "D":
            self.cost += DELETE
            return
        self.cost += (REROLE if edit == "R" else 0) + (TRUNCATED if letter.isupper() else 0)
        self.state = FREE[self.state] if edit == "R" else KEPT[letter.lower()][self.state]
        self.say(role if edit == "K" else "user" if self.state == 2 else "assistant", text)

    def result(self) -> tuple:
        self.start()
        more = ENDS[self.state] // INSERT
        for _ in range(more):
            self.insert()
        gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        count = self.letters.count
        return (
            self.conv_id, gaps, count("b"), count("d"), sum(map(count, "SUAX")), self.illegal, self.cost, self.audit + "I" * more,
            self.sha.hexdigest(), self.row,
        )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_one, done = None, []
    names = [c.split()[0] for c in _REPAIRED.split(", ")]

    def out() -> pa.RecordBatch:
        types = [pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in names]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names)

    for batch in batches:
        for key, conv_id, kind, turn, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv", "conv_id", "kind", "turn", "role", "text")]):
            if open_one is None or open_one.key != key:
                if open_one is not None:
                    done.append(open_one.result())
                open_one = _Conversation(key, conv_id)
            if kind == 0:  # a block: its word and its audit
                open_one.words.append(role)
                open_one.pieces.append(text)
            else:
                open_one.conv_id = conv_id
                if kind == 1:
                    open_one.see(turn, role, text)
        if done:
            yield out()
            done = []
    if open_one is not None:
        done.append(open_one.result())
        yield out()


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv, conv_id, turn, role, text, dropped), read several times."""
    here = rows.filter(~F.col("dropped"))
    blocks = durable(words_of(here), "words")
    grammar = learn(durable(blocks.groupBy("word").agg(F.count("*").alias("n")), "distinct"))
    made = audits(blocks, grammar).select(
        "conv", F.lit(None).cast("long").alias("conv_id"), F.lit(0).alias("kind"), F.col("block").alias("turn"), F.lit(None).cast("binary").alias("mark"),
        F.col("word").alias("role"), F.col("audit").alias("text"),
    )
    said = here.select("conv", "conv_id", F.lit(1).alias("kind"), "turn", _mark().alias("mark"), "role", "text")
    # a conversation may have lost all its rows
    gone = rows.filter("dropped").select("conv", "conv_id").distinct().select(
        "conv", "conv_id", F.lit(2).alias("kind"), *[F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("mark", "binary"), ("role", "string"), ("text", "string"))])
    ordered = made.unionByName(said).unionByName(gone).repartition("conv").sortWithinPartitions("conv", "kind", F.col("turn").asc_nulls_first(), "mark")
    ship(rows.sparkSession)
    return ordered.mapInArrow(_walk, _REPAIRED)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The repair of ``conversations`` after damage."""
    return repair(damaged(conversations))
