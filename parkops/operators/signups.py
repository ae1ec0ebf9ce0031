"""Sign-ups of a batch, settled in few rounds.

Row at a time, a sign-up is refused if its id or phone is taken, by a user or by a sign-up
accepted before it; a refused one blocks nobody. So whether a row is accepted depends on the
open rows before it that share its id or phone. In each round a row with none is accepted;
a row with one depends on that one alone: it is accepted if and only if the other is not.
Such rows form chains, which are contracted by pointer jumping with a parity, so a chain of
any length takes a logarithmic number of joins. Rows with several earlier ones wait for the
next round, in which all that share a key with an accepted row are gone.

Rows are carried as their position and two keys; groups are reduced to their first two rows,
so a key held by a third of the rows is no large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parkops.functions import text as T
from parkops.operators.ranking import asc, with_position
from parkops.operators.tables import assign_identities
from parkops.session import cut_lineage
from parkops.sources import schema as S

COLS = ("uni_id", "name", "phone", "user_type")


def copies(df: DataFrame) -> DataFrame:
    """Distinct rows of ``df`` with how many copies there are (``_n``)."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))


def _first_two(rows: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """(key, first, second): the two least positions of each key."""
    known = rows.filter(F.col(key).isNotNull()).select(key, "pos")
    least = known.groupBy(key).agg(F.min("pos").alias(first))
    rest = known.join(least, key).filter(F.col("pos") > F.col(first))
    return least.join(rest.groupBy(key).agg(F.min("pos").alias(second)), key, "left")


def _earlier(key: str, first: str, second: str) -> Column:
    """How many earlier rows share the key: 0, 1 or 2 (two or more)."""
    return (F.when(F.col(key).isNull() | (F.col("pos") == F.col(first)), 0)
            .when(F.col("pos") == F.col(second), 1).otherwise(2))


ACCEPTED, LINK, WAITS = 0, 1, 2


def _round(rows: DataFrame) -> DataFrame:
    """(pos, accepted) of the rows that this round decides."""
    met = (rows.join(_first_two(rows, "lid", "i1", "i2"), "lid", "left")
           .join(_first_two(rows, "phone", "p1", "p2"), "phone", "left")
           .withColumn("ci", _earlier("lid", "i1", "i2")).withColumn("cp", _earlier("phone", "p1", "p2")))
    # the same earlier row may be met by both keys
    same = (F.col("ci") == 1) & (F.col("cp") == 1) & (F.col("i1") == F.col("p1"))
    before = F.when(same, 1).otherwise(F.col("ci") + F.col("cp"))
    at = cut_lineage(met.select(
        "pos", F.when(before == 1, F.when(F.col("ci") == 1, F.col("i1")).otherwise(F.col("p1")))
        .otherwise(F.col("pos")).alias("to"),
        F.least(before, F.lit(WAITS)).alias("kind"), F.lit(False).alias("flip")).withColumn(
            "flip", F.col("kind") == LINK))
    while not at.filter(F.col("kind") == LINK).isEmpty():
        nxt = at.select(F.col("pos").alias("to"), F.col("to").alias("_to"), F.col("kind").alias("_kind"),
                        F.col("flip").alias("_flip"))
        link = F.col("kind") == LINK
        at = cut_lineage(at.join(nxt, "to").select(
            "pos", F.when(link, F.col("_to")).otherwise(F.col("to")).alias("to"),
            F.when(link, F.col("_kind")).otherwise(F.col("kind")).alias("kind"),
            F.when(link, F.col("flip") != F.col("_flip")).otherwise(F.col("flip")).alias("flip")))
    return at.filter(F.col("kind") == ACCEPTED).select("pos", (~F.col("flip")).alias("accepted"))


def settle(rows: DataFrame) -> DataFrame:
    """The accepted ones of (pos, lid, phone): ``pos`` unique, the order; null phones are
    shared with nobody."""
    still = cut_lineage(rows.select("pos", "lid", "phone"))
    accepted = still.limit(0)
    while not still.isEmpty():
        decided = cut_lineage(still.join(_round(still), "pos"))
        won = decided.filter("accepted").select("pos", "lid", "phone")
        accepted = accepted.unionByName(won)
        still = cut_lineage(still.join(decided.select("pos"), "pos", "left_anti")
                            .join(won.select("lid"), "lid", "left_anti")
                            .join(won.select("phone"), "phone", "left_anti"))
    return accepted


def check(signups: DataFrame, users: DataFrame, valid: Column,
          invalid: str) -> tuple[DataFrame, DataFrame]:
    """Distinct sign-ups (trimmed) with ``_n`` copies and the ``reason`` against them: the id
    is taken (up to case), else ``invalid`` where ``valid`` is not true, else the phone is.
    And the positions of those accepted."""
    others = [c for c in signups.columns if c not in COLS + ("submitted_at",)]
    u = copies(signups.select("submitted_at", *others,
                              *[T.trim_app(c).alias(c) for c in COLS if c in signups.columns]))
    if "user_type" not in u.columns:
        u = u.withColumn("user_type", F.lit(None).cast("string"))
    order = [asc(c) for c in ("submitted_at", *COLS, *others)]
    u = with_position(u.withColumn("lid", F.coalesce(F.lower("uni_id"), F.lit(""))), order)
    ids = users.select(F.lower("uni_id").alias("lid")).distinct().withColumn("_id_taken", F.lit(True))
    phones = (users.filter(F.col("phone").isNotNull()).select("phone").distinct()
              .withColumn("_ph_taken", F.lit(True)))
    u = cut_lineage(u.join(ids, "lid", "left").join(phones, "phone", "left")
                    .withColumn("_valid", F.coalesce(valid, F.lit(False))))
    won = settle(u.filter(F.col("_id_taken").isNull() & F.col("_ph_taken").isNull() & F.col("_valid")))
    of_id = won.select("lid", F.col("pos").alias("_i"))
    of_phone = won.filter(F.col("phone").isNotNull()).select("phone", F.col("pos").alias("_p"))
    j = u.join(of_id, "lid", "left").join(of_phone, "phone", "left")
    reason = (F.when(F.col("_id_taken").isNotNull() | (F.col("_i") < F.col("pos")), "uni_id_taken")
               .when(~F.col("_valid"), invalid)
               .when(F.col("_ph_taken").isNotNull() | (F.col("_p") < F.col("pos")), "phone_taken"))
    return j.withColumn("reason", reason), won.select("pos")


def _signups(users_in: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    return check(users_in.select(*COLS, "submitted_at"), users,
                 F.col("user_type").isin(*S.USER_TYPES), "invalid_type")


def _managers(managers_in: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All four fields are required (an id of '0' counts as none); the password itself stays
    behind, only whether there is one goes on."""
    filled = [~T.is_blank(c) for c in ("uni_id", "name", "phone")]
    rows = managers_in.select("uni_id", "name", "phone", "submitted_at", F.coalesce(
        ~F.col("password").isin("", "0"), F.lit(False)).alias("has_password"))
    return check(rows, users, filled[0] & filled[1] & filled[2] & F.col("has_password"), "missing_field")


def _new_users(checked: tuple[DataFrame, DataFrame], users: DataFrame, user_type: Column) -> DataFrame:
    rows, won = checked
    ok = rows.filter(F.col("reason").isNull())
    ok = assign_identities(ok, {"user_id": users}, [asc("pos")], won)
    new = ok.select("user_id", "uni_id", "name", "phone", user_type.alias("user_type"),
                    F.lit(None).cast("boolean").alias("access_status"),
                    F.col("submitted_at").alias("created_at"))
    return users.unionByName(new.select(*users.columns))


def _rejected(checked: tuple[DataFrame, DataFrame]) -> DataFrame:
    """One row per distinct rejected sign-up, with the number of its copies; the further
    copies of an accepted one meet its id."""
    n = F.col("_n") - F.when(F.col("reason").isNull(), 1).otherwise(0)
    return checked[0].select("uni_id", "submitted_at", F.coalesce("reason", F.lit("uni_id_taken")).alias("reason"),
                          n.cast("long").alias("copies")).filter("copies > 0")


def register_users_users(users_in: DataFrame, users: DataFrame) -> DataFrame:
    return _new_users(_signups(users_in, users), users, F.col("user_type"))


def register_users_rejected(users_in: DataFrame, users: DataFrame) -> DataFrame:
    return _rejected(_signups(users_in, users))


def register_managers_users(managers_in: DataFrame, users: DataFrame) -> DataFrame:
    return _new_users(_managers(managers_in, users), users, F.lit("Manager"))


def register_managers_rejected(managers_in: DataFrame, users: DataFrame) -> DataFrame:
    return _rejected(_managers(managers_in, users))
