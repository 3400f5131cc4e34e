"""Cross-record checks: copies, conflicts, shared identities, coverage by intervals, misfiled records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text


def later_copies(rows: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Rows whose content repeats an earlier row's (smaller key): (row_id, first_id).

    A group-by finds the few contents that occur more than once, and only rows with one of these are looked
    at again; a content that a third of all rows share is counted by partial aggregation, not in one window.
    """
    hashed = rows.select(F.col(key).alias("row_id"), text.row_hash([F.col(c) for c in content]).alias("h"))
    repeated = hashed.groupBy("h").agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return hashed.join(repeated, "h").where("row_id > first_id").select("row_id", "first_id")


def conflicting_keys(rows: DataFrame, key: str, identity: str, content: list[str]) -> DataFrame:
    """Rows that repeat an identity (trimmed) with another content than its first row: (row_id, identity)."""
    t = rows.where(F.col(identity).isNotNull()).select(
        F.col(key).alias("row_id"), text.strip(F.col(identity)).alias("identity"), text.row_hash([F.col(c) for c in content]).alias("h"))
    firsts = t.groupBy("identity").agg(F.min(F.struct("row_id", "h")).alias("first"), F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi")
    return t.join(firsts, "identity").where("h <> first.h").select("row_id", "identity")


def shared_identity(people: DataFrame, key: str, name: Column, born: Column, owner: str) -> DataFrame:
    """Rows of people whose normalized name and birth date belong to two owners or more: (row_id, owner, group_id);
    the group is named after its smallest owner."""
    t = people.select(F.col(key).alias("row_id"), F.col(owner).alias("owner"), text.normalize_name(name).alias("who"), born.alias("born")).where("who <> '' and born is not null and owner is not null")
    groups = t.groupBy("who", "born").agg(F.min("owner").alias("group_id"), F.max("owner").alias("other")).where("group_id <> other").drop("other")
    return t.join(groups, ["who", "born"]).select("row_id", "owner", "group_id")


def interval_state(events: DataFrame, intervals: DataFrame, keys: list[str], key: str, day: str) -> DataFrame:
    """Per event HELD, EXPIRED (with the latest end among the intervals that had begun) or MISSING, from intervals
    (keys, start, end; open if end is null) on equal keys; null where a key or the day is null."""
    known = F.lit(True)
    for k in [*keys, day]:
        known = known & F.col(k).isNotNull()
    base = events.select(F.col(key).alias("row_id"), *keys, F.col(day).alias("day"), known.alias("known"))
    begun = F.col("start") <= F.col("day")
    per_event = (
        base.where("known").join(intervals.select(*keys, "start", "end"), keys)
        .groupBy("row_id").agg(
            F.bool_or(begun).alias("any_begun"),
            F.bool_or(begun & (F.col("end").isNull() | (F.col("end") >= F.col("day")))).alias("covered"),
            F.max(F.when(begun, F.col("end"))).alias("last_end"),
        )
    )
    return base.select("row_id", "known").join(per_event, "row_id", "left").select(
        "row_id",
        F.when(~F.col("known"), None).when(F.col("covered"), "HELD").when(F.col("any_begun"), "EXPIRED").otherwise("MISSING").alias("state"),
        F.when(F.col("any_begun") & ~F.col("covered"), F.col("last_end")).alias("last_end"),
    )


def coverage_matrix(events: DataFrame, intervals: DataFrame, cell: list[str]) -> DataFrame:
    """Per cell whether it is held, used, or used without being held, and how many events fall in it."""
    held = intervals.groupBy(*cell).agg(F.lit(True).alias("held"))
    used = events.groupBy(*cell).agg(F.count(F.lit(1)).alias("events"))
    return held.join(used, cell, "full_outer").select(
        *cell, F.when(F.col("held") & F.col("events").isNotNull(), "HELD_USED").when(F.col("held"), "HELD").otherwise("GAP").alias("state"),
        F.coalesce("events", F.lit(0)).cast("bigint").alias("events"))


def licence_gaps(events: DataFrame, licences: DataFrame, key: str, agent: str, state: str) -> DataFrame:
    """Events whose agent is known but holds no licence for their state: (row_id, agent, state). licences has one
    row per agent and state; agents and states are spread over the join keys, not collected per agent."""
    agents = licences.select("agent").distinct()
    e = events.where(F.col(agent).isNotNull() & F.col(state).isNotNull()).select(F.col(key).alias("row_id"), F.col(agent).alias("agent"), F.col(state).alias("state"))
    return e.join(agents, "agent", "left_semi").join(licences.select("agent", "state").distinct(), ["agent", "state"], "left_anti").select("row_id", "agent", "state")


def misfiled(edges: DataFrame, lines: DataFrame, book: DataFrame, clients: DataFrame) -> DataFrame:
    """Policies whose payment lines all name one and the same other client: (policy_rec, filed_client, named_client, lines).

    A line speaks if it has one strong candidate, met by both keys, and names a person (name and birth date) that
    exactly one client other than the filed one is. It speaks for the filed client if that client is
    the person. One line for the filed client, or lines that name different clients, silence the policy.
    """
    strong = edges.where("mask & 3 <> 0").groupBy("line_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("policy_rec", "mask")).alias("e")).where("n = 1 and e.mask & 3 = 3").select("line_id", F.col("e.policy_rec").alias("policy_rec"))
    person = lambda n, d: F.when((text.name_key(n) != "") & d.isNotNull(), F.concat_ws("|", text.name_key(n), d.cast("string")))
    people = clients.select(F.trim("client_id").alias("client"), person(F.concat_ws(" ", "first_name", "last_name"), F.col("dob")).alias("person")).where("client is not null and person is not null").distinct()
    said = lines.select("line_id", person(F.col("member_name"), F.col("born")).alias("person")).where("person is not null")
    filed = book.select(F.col("_rec").alias("policy_rec"), F.trim("client_id").alias("filed"))
    spoken = strong.join(said, "line_id").join(filed, "policy_rec").join(people.select(F.col("client").alias("filed")).distinct(), "filed", "left_semi")
    owners = people.groupBy("person").agg(F.min("client").alias("a"), F.max("client").alias("b"), F.count(F.lit(1)).alias("n"))
    mine = people.select(F.col("client").alias("filed"), "person", F.lit(True).alias("own"))
    votes = spoken.join(owners, "person").join(mine, ["filed", "person"], "left").withColumn(
        "named", F.when(F.col("own"), F.col("filed")).when(F.col("n") == 1, F.col("a"))).where("named is not null")
    return (
        votes.groupBy("policy_rec", "filed").agg(F.min("named").alias("lo"), F.max("named").alias("hi"), F.count(F.lit(1)).cast("bigint").alias("lines"))
        .where("lo = hi and lo <> filed").select("policy_rec", F.col("filed").alias("filed_client"), F.col("lo").alias("named_client"), "lines")
    )


def packet_issues(clients: DataFrame, policies: DataFrame) -> DataFrame:
    """What keeps a set of tables from being handed over: (issue, key, rows) for repeated identities and policies whose
    client is not among the clients."""
    def repeated(df: DataFrame, key: str, issue: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).groupBy(text.strip(F.col(key)).alias("key")).agg(F.count(F.lit(1)).cast("bigint").alias("rows")).where("rows > 1").select(F.lit(issue).alias("issue"), "key", "rows")

    have = clients.where("client_id is not null").select(text.strip(F.col("client_id")).alias("key")).distinct()
    lost = policies.where("client_id is not null").select(text.strip(F.col("client_id")).alias("key")).join(have, "key", "left_anti").groupBy("key").agg(F.count(F.lit(1)).cast("bigint").alias("rows")).select(F.lit("MISSING_CLIENT").alias("issue"), "key", "rows")
    return repeated(clients, "client_id", "DUPLICATE_CLIENT").unionByName(repeated(policies, "policy_id", "DUPLICATE_POLICY")).unionByName(lost)


def cross_counts(policies: DataFrame, clients: DataFrame, agents: DataFrame, by: str) -> DataFrame:
    """Per group how many policies find their client, their agent, both, and how many state another state than their client."""
    c = clients.where("client_id is not null").groupBy(text.strip(F.col("client_id")).alias("ck")).agg(F.min_by("state", "rec_id").alias("client_state"))
    a = agents.where("npn is not null").select(text.strip(F.col("npn")).alias("ak")).distinct().withColumn("has_agent", F.lit(True))
    j = policies.withColumn("ck", text.strip(F.col("client_id"))).withColumn("ak", text.strip(F.col("writing_agent_npn"))).join(c.withColumn("has_client", F.lit(True)), "ck", "left").join(a, "ak", "left")
    n = lambda cond: F.count_if(cond).cast("bigint")
    return j.groupBy(by).agg(F.count(F.lit(1)).cast("bigint").alias("policies"), n(F.col("has_client")).alias("with_client"), n(F.col("has_agent")).alias("with_agent"), n(F.col("has_client") & F.col("has_agent")).alias("with_both"),
                             n(F.col("state") != F.col("client_state")).alias("other_state"))
