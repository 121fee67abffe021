"""Momenta of rows and instances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..enums import INTERACTION, SEMANTIC
from ..store import Workspace
from .layout import first_last_steps


def row_kinematics(rows: DataFrame, tracks: DataFrame, columns: Sequence[str], event: str = "event_id", by: str = "geant4_trackid", track: str = "track_id") -> DataFrame:
    """``rows`` with the ``columns`` of their track as doubles, NaN where the track is unknown: every piece of a split track carries its track's."""
    t = tracks.select(F.col(event).alias("k_e"), F.col(track).alias("k_t"), F.lit(True).alias("k_has"), *(F.col(c).cast("double").alias(f"k_{c}") for c in columns))
    met = rows.join(t, (F.col(event) == F.col("k_e")) & (F.col(by) == F.col("k_t")), "left")
    return met.select(*rows.columns, *(F.when(F.col("k_has"), F.col(f"k_{c}")).otherwise(float("nan")).alias(c) for c in columns))


def pair_members(particles: DataFrame, instances: DataFrame) -> DataFrame:
    """event_id, ``inst_id``, ``track_id``, distinct: the converting electrons and positrons of instances that a photon heads, by their track (a pair split into pieces counts once).

    :param particles: event_id, id, parent_id, pdg, interaction_type, geant4_trackid; :param instances: event_id, id, inst_id
    """
    p = particles.where((F.abs("pdg") == 11) & (F.col("interaction_type") == INTERACTION["conversion"])).select("event_id", "id", "parent_id", "geant4_trackid")
    i = instances.select(F.col("event_id").alias("i_e"), F.col("id").alias("i_id"), "inst_id")
    heads = particles.where("pdg = 22").select(F.col("event_id").alias("h_e"), F.col("id").alias("h_id"))
    met = p.join(i, (F.col("event_id") == F.col("i_e")) & (F.col("id") == F.col("i_id")) & (F.col("parent_id") == F.col("inst_id"))).join(heads, (F.col("event_id") == F.col("h_e")) & (F.col("inst_id") == F.col("h_id")), "left_semi")
    return met.select("event_id", "inst_id", F.col("geant4_trackid").alias("track_id")).distinct()


def instance_kinematics(steps: DataFrame, particles: DataFrame, instances: DataFrame, tracks: DataFrame, keep: Sequence[str] = ("x", "y", "z"), momentum: Sequence[str] = ("px", "py", "pz")) -> DataFrame:
    """First and last step of each instance, and the momentum it starts with.

    :param steps: event_id, particle_id (that holds it), track_id (that made it), ``step_id``, ``t`` and ``keep``
    :param particles: event_id, id, parent_id, pdg, interaction_type, geant4_trackid, sem_type; ``buried`` (optional): a delta merged into its track
    :param instances: event_id, id (of the particle), inst_id, ``inst_sem`` (sem_type of the instance)
    :param tracks: event_id, track_id and ``momentum`` at the start
    :return: event_id, inst_id, first_t, first_step_id, first_<keep>, last_ likewise (null for showers), first_<momentum>: the start of the step's track; of a shower whose first step was made by the pair its photon converted
        into, the sum over the pair

    Steps count where their track is one that the instance follows: that of a member that is neither low-energy nor buried, or of the pair. An instance without such steps takes all of its steps.
    """
    ws = Workspace(steps.sparkSession, "kinematics")
    i = instances.select(F.col("event_id").alias("i_e"), F.col("id").alias("i_id"), "inst_id", F.coalesce(F.col("inst_sem") == SEMANTIC["shower"], F.lit(False)).alias("is_shower"))
    member = particles.join(i.drop("is_shower"), (F.col("event_id") == F.col("i_e")) & (F.col("id") == F.col("i_id")))
    buried = F.coalesce(F.col("buried"), F.lit(False)) if "buried" in particles.columns else F.lit(False)
    pair = ws.keep(pair_members(particles, instances))
    follows = member.where(~F.coalesce(F.col("sem_type") == SEMANTIC["le_scatter"], F.lit(False)) & ~buried).select("event_id", "inst_id", F.col("geant4_trackid").alias("track_id")).unionByName(pair).distinct()
    f = follows.select(F.col("event_id").alias("f_e"), F.col("inst_id").alias("f_i"), F.col("track_id").alias("f_t"))
    held = steps.join(i, (F.col("event_id") == F.col("i_e")) & (F.col("particle_id") == F.col("i_id"))).drop("i_e", "i_id")
    held = held.join(f, (F.col("event_id") == F.col("f_e")) & (F.col("inst_id") == F.col("f_i")) & (F.col("track_id") == F.col("f_t")), "left").withColumn("allowed", F.col("f_e").isNotNull())
    ends = first_last_steps(held.select("event_id", "inst_id", "t", "step_id", "track_id", *keep, "allowed", "is_shower"), keep=(*keep, "track_id"))
    t = tracks.select(F.col("event_id").alias("t_e"), F.col("track_id").alias("t_t"), *(F.col(c).cast("double").alias(f"t_{c}") for c in momentum))
    own = ends.join(t, (F.col("event_id") == F.col("t_e")) & (F.col("first_track_id") == F.col("t_t")), "left").drop("t_e", "t_t")
    p = pair.select(F.col("event_id").alias("p_e"), F.col("inst_id").alias("p_i"), F.col("track_id").alias("p_t"))
    total = p.join(t, (F.col("p_e") == F.col("t_e")) & (F.col("p_t") == F.col("t_t"))).groupBy("p_e", "p_i").agg(*(F.sum(f"t_{c}").alias(f"p_{c}") for c in momentum)).withColumnsRenamed({"p_e": "s_e", "p_i": "s_i"})
    by_pair = own.join(p, (F.col("event_id") == F.col("p_e")) & (F.col("inst_id") == F.col("p_i")) & (F.col("first_track_id") == F.col("p_t")), "left").join(total, (F.col("event_id") == F.col("s_e")) & (F.col("inst_id") == F.col("s_i")), "left")
    summed = F.col("p_t").isNotNull() & F.col("shower")
    shower = i.select(F.col("i_e").alias("w_e"), F.col("inst_id").alias("w_i"), "is_shower").groupBy("w_e", "w_i").agg(F.max("is_shower").alias("shower"))
    met = by_pair.join(shower, (F.col("event_id") == F.col("w_e")) & (F.col("inst_id") == F.col("w_i")))
    return met.select(*(c for c in ends.columns), *(F.when(summed, F.col(f"p_{c}")).otherwise(F.col(f"t_{c}")).alias(f"first_{c}") for c in momentum))
