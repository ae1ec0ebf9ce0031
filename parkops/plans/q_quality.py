"""Registered data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parkops.functions import text as T
from parkops.operators import quality as Q
from parkops.operators import tables as TB
from parkops.plans.registry import query
from parkops.sources import schema as S
from parkops.sources.staged import StagedGarage


@query("dq_unique")
def _(g):
    return Q.dq_unique(g.table)


@query("dq_unique_ci")
def _(g):
    return Q.dq_unique_ci(g.users)


@query("dq_domain")
def _(g):
    return Q.dq_domain(g.table)


@query("dq_foreign_key")
def _(g):
    return Q.dq_foreign_key(g.table)


@query("dq_not_null")
def _(g):
    return Q.dq_not_null(g.table)


@query("dq_max_length")
def _(g):
    return Q.dq_max_length(g.table)


def _staged(g):
    return StagedGarage(g.spark, g.sf_dir)


# the same jobs over an import in which every rule is broken somewhere
@query("dq_constraints__staged")
def _(g):
    return Q.dq_constraints(_staged(g).table)


@query("dq_unique__staged")
def _(g):
    return Q.dq_unique(_staged(g).table)


@query("dq_foreign_key__staged")
def _(g):
    return Q.dq_foreign_key(_staged(g).table)


@query("dq_domain__staged")
def _(g):
    return Q.dq_domain(_staged(g).table)


@query("dq_not_null__staged")
def _(g):
    return Q.dq_not_null(_staged(g).table)


@query("dq_max_length__staged")
def _(g):
    return Q.dq_max_length(_staged(g).table)


@query("dq_card_fields")
def _(g):
    return Q.dq_card_fields(g.payments_in)


@query("dq_spot_choice")
def _(g):
    return Q.dq_spot_choice(g.submissions, g.parking_spots, g.parking_garage)


@query("dq_contact_fields")
def _(g):
    return Q.dq_contact_fields(g.users)


@query("dq_payable")
def _(g):
    return Q.dq_payable(g.payments_in, g.service_request)


@query("in_domain")
def _(g):
    return g.users_in.select("uni_id", "user_type",
                             F.col("user_type").isin(*S.USER_TYPES).alias("type_allowed"))


@query("like_filter")
def _(g):
    return g.vehicle.filter(T.like_filter("color", "re")).select("vehicle_id", "color")


@query("plate_taken_by_other")
def _(g):
    return TB.plate_taken_by_other(g.vehicle_edits, g.vehicle)


@query("id_or_phone_match")
def _(g):
    return TB.id_or_phone_match(g.users_in, g.users)


@query("dq_signup_fields")
def _(g):
    return Q.dq_contact_fields(g.managers_in, "uni_id")


@query("scalar_card")
def _(g):
    """The card fields of payments as their inputs show them."""
    return g.payments_in.filter(F.col("method") == "Credit").select(
        "request_id", T.card_number_input(F.concat_ws(" \t", "card_number", "cardholder_name"))
        .alias("typed_text"), T.card_number_input("card_number").alias("card_number"),
        T.expiry_input("card_expiry").alias("card_expiry"),
        T.cvv_input(F.concat(F.lit("cvv "), "card_cvv")).alias("card_cvv"))


@query("garage_labels")
def _(g):
    """The open / closed badge of every garage."""
    return g.parking_garage.select("garage_id", T.open_label(F.col("garage_status")).alias("open_label"))
