"""Versions of files and receipts of statements: what replaces what, what is current, what conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import row_hash
from ledgerloom.runtime import durable


def ancestors(versions: DataFrame, rounds: int = 40) -> DataFrame:
    """(version, ancestor) for every pair along replacement chains of versions (version, parent).

    Paths double in every round, so a chain of a million versions takes twenty rounds, each one shuffle join;
    every other round is written out to keep the lineage short. A version that leads back to itself raises.
    """
    paths = versions.where("parent is not null").select("version", F.col("parent").alias("ancestor"))
    reach = step = durable(paths)  # reach: distances 1 to 2^k, step: distance 2^k
    for _ in range(rounds):
        longer = reach.alias("r").join(step.alias("s"), F.col("r.ancestor") == F.col("s.version")).select("r.version", "s.ancestor")
        far = durable(step.alias("x").join(step.alias("y"), F.col("x.ancestor") == F.col("y.version")).select("x.version", "y.ancestor"))
        reach = durable(reach.unionByName(longer).distinct())
        if far.where("version = ancestor").limit(1).count():
            raise ValueError("a version replaces itself")
        if far.isEmpty():
            return reach
        step = far
    raise ValueError("replacement chains are longer than expected")


def superseded(versions: DataFrame, delivered: DataFrame, rounds: int = 60) -> DataFrame:
    """Versions that a delivered version replaces, at any distance.

    Every version keeps one pointer, which doubles its reach in each round, and hands what it knows (that it, or one
    within reach that leads to it, is delivered) to where it points: n rows a round, whatever the length of
    the chains. Pointers that never run out belong to a version that leads back to itself, which raises.
    """
    hit = delivered.select("version").distinct().withColumn("hit", F.lit(True))
    chain = versions.select("version", "parent").dropDuplicates(["version"]).join(hit, "version", "left").select("version", "parent", F.col("parent").alias("to"), F.coalesce("hit", F.lit(False)).alias("hit"))
    chain = durable(chain)
    for _ in range(rounds):
        if chain.where("to is not null").isEmpty():
            break
        handed = chain.where("hit and to is not null").select(F.col("to").alias("version"), F.lit(True).alias("handed")).distinct()
        ahead = chain.select(F.col("version").alias("to"), F.col("to").alias("beyond"))
        chain = durable(chain.join(handed, "version", "left").join(ahead, "to", "left").select(
            "version", "parent", F.col("beyond").alias("to"), (F.col("hit") | F.coalesce("handed", F.lit(False))).alias("hit")))
    else:
        raise ValueError("a version replaces itself")
    return chain.where("hit and parent is not null").select(F.col("parent").alias("version")).distinct()


def readiness(expected: DataFrame, versions: DataFrame, delivered: DataFrame, keys: list[str]) -> DataFrame:
    """State of each expected file (keys, least_date): missing, conflicting, unknown, stale or current.

    versions (version, parent, keys, sha, source_date); only delivered versions that no delivered one replaces count.
    """
    active = versions.join(delivered.select("version").distinct(), "version", "left_semi").join(superseded(versions, delivered), "version", "left_anti")
    facts = active.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("sha", "source_date")).alias("lo"), F.max(F.struct("sha", "source_date")).alias("hi"), F.min("source_date").alias("source_date"))
    return expected.join(facts, keys, "left").select(
        *keys, F.when(F.col("n").isNull(), "missing").when(~F.col("lo").eqNullSafe(F.col("hi")), "conflicting")
        .when(F.col("least_date").isNull() | F.col("source_date").isNull(), "unknown").when(F.col("source_date") < F.col("least_date"), "stale").otherwise("current").alias("state"))


def overall_state(states: DataFrame) -> DataFrame:
    order = ["conflicting", "missing", "unknown", "stale", "current"]
    worst = F.min(F.array_position(F.lit(order), F.col("state")))
    return states.agg(F.coalesce(F.get(F.lit(order), (worst - 1).cast("int")), F.lit("unknown")).alias("state"))


def receipt_ledger(receipts: DataFrame) -> DataFrame:
    """(scope, seq, receipt_id, revision, digest, state, reason): what becomes of receipts (scope, seq, receipt_id,
    revision, digest, declared, replaces), taken in order of seq within a scope.

    The rule: the first receipt is active; so is one that takes over, that is, names the active revision as the
    one it replaces and bears a new name itself. Content that is known is a duplicate. All else is a conflict,
    and what repeats content in conflict is evidence of it. Whoever is taken over is superseded.

    The decisions of one scope are a fold over its receipts (as many as a statement was sent times), with what
    is known so far as the accumulator; nulls count as one more value. Scopes are spread by key.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    row = F.struct("seq", F.col("receipt_id").alias("id"), "revision", "digest", text("revision").alias("name"), text("digest").alias("content"), text("declared").alias("claim"), F.col("replaces").cast("string").alias("replaces"))
    grouped = receipts.groupBy("scope").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    strings = F.array().cast("array<string>")
    known_so_far = F.struct(
        F.lit(None).cast("string").alias("active"), strings.alias("contents"), strings.alias("names"), strings.alias("disputed"),
        F.array().cast("array<struct<claim:string,content:string>>").alias("claims"), F.array().cast("array<struct<state:string,reason:string>>").alias("verdicts"))

    def verdict(known, r):
        """The first line of the table that applies."""
        first = known["active"].isNull()
        on_active = ~first & r["replaces"].eqNullSafe(known["active"])
        takes_over = on_active & ~F.array_contains(known["names"], r["name"])
        other_claim = F.exists(known["claims"], lambda c: (c["claim"] == r["claim"]) & (c["content"] != r["content"]))
        say = lambda state, reason=None: F.struct(F.lit(state).alias("state"), F.lit(reason).cast("string").alias("reason"))
        table = (
            (F.array_contains(known["disputed"], r["content"]) & ~(takes_over & ~other_claim), say("duplicate", "duplicate_conflict_evidence")),
            (other_claim, say("conflict", "declared_hash_collision")),
            (takes_over, say("active")),
            (F.array_contains(known["contents"], r["content"]) & (r["replaces"].isNull() | on_active), say("duplicate")),
            (F.array_contains(known["contents"], r["content"]), say("conflict", "replacement_not_current")),
            (F.array_contains(known["names"], r["name"]), say("conflict", "revision_id_reused")),
            (first & r["replaces"].isNotNull(), say("conflict", "replacement_without_original")),
            (~first, say("conflict", "replacement_not_current")),
        )
        out = say("active")
        for condition, says in reversed(table):
            out = F.when(condition, says).otherwise(out)
        return out

    def learn(known, r):
        v = verdict(known, r)
        active, conflict = v["state"] == "active", v["state"] == "conflict"
        return F.struct(
            F.when(active, r["name"]).otherwise(known["active"]).alias("active"),
            F.when(active, F.array_append(known["contents"], r["content"])).otherwise(known["contents"]).alias("contents"),
            F.array_append(known["names"], r["name"]).alias("names"),
            F.when(active, F.array_remove(known["disputed"], r["content"])).when(conflict, F.array_append(known["disputed"], r["content"])).otherwise(known["disputed"]).alias("disputed"),
            F.when(F.exists(known["claims"], lambda c: c["claim"] == r["claim"]), known["claims"]).otherwise(F.array_append(known["claims"], F.struct(r["claim"].alias("claim"), r["content"].alias("content")))).alias("claims"),
            F.array_append(known["verdicts"], v).alias("verdicts"))

    told = grouped.select("scope", "rows", F.aggregate("rows", known_so_far, learn, lambda k: k["verdicts"]).alias("verdicts"))
    each = told.select("scope", F.array_max(F.transform("verdicts", lambda v, i: F.when(v["state"] == "active", i))).alias("last"), F.posexplode(F.arrays_zip("rows", "verdicts")).alias("i", "z"))
    state = F.when((F.col("z.verdicts.state") == "active") & (F.col("i") < F.col("last")), "superseded").otherwise(F.col("z.verdicts.state"))
    return each.select("scope", F.col("z.rows.seq").alias("seq"), F.col("z.rows.id").alias("receipt_id"), F.col("z.rows.revision").alias("revision"), F.col("z.rows.digest").alias("digest"), state.alias("state"), F.col("z.verdicts.reason").alias("reason"))


def ledger_totals(decided: DataFrame, lines: DataFrame, keys: list[str], categories: list[str]) -> DataFrame:
    """Per keys the amounts by category and their sum over the lines of active receipts. lines (receipt_id, keys, category,
    amount); a receipt that is no longer active, a duplicate or in conflict adds nothing; null amounts add nothing."""
    live = lines.join(decided.where("state = 'active'").select("receipt_id").distinct(), "receipt_id", "left_semi")
    return live.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(F.col("category") == c, F.col("amount"))), F.lit(0)).cast("decimal(18,2)").alias(c) for c in categories],
        F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(18,2)").alias("total"))


def package_digest(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, digest): one SHA-256 over a package's rows, whatever their order. Rows are hashed one by one, the hashes counted and
    sorted, so equal rows stay distinct; a package's hashes (64 characters a row) are gathered in one task."""
    hashed = rows.select(*keys, row_hash([F.col(c) for c in columns]).alias("h"))
    return hashed.groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("x", "h", F.col("n").cast("string")))), "|"), 256).alias("digest"))


def out_of_order(receipts: DataFrame, at: str = "received_at") -> DataFrame:
    """Scopes in which a later receipt bears an earlier time than one before it."""
    from pyspark.sql import Window

    before = F.lag(at).over(Window.partitionBy("scope").orderBy("seq"))
    return receipts.withColumn("before", before).where(F.col(at) < F.col("before")).select("scope", "seq")
