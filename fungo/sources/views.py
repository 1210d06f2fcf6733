"""Pitch-level tables derived from order tables, as SQL that several dialects accept.

They give the operators data of the right shape wherever only order tables are
at hand, and let another engine compute the same answers for comparison.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {}

VIEWS["games_v"] = """
select o_orderkey as game_pk, cast(o_orderdate as date) as game_date, cast(year(o_orderdate) as int) as season,
 case when o_orderkey % 10 = 0 then 'A' else 'R' end as game_type,
 case when o_orderstatus = 'P' then 'In Progress' else 'Final' end as status,
 cast(100 + o_custkey % 30 as int) as home_team_id, cast(100 + (o_custkey * 7 + o_orderkey) % 30 as int) as away_team_id,
 cast(o_orderkey % 11 as int) as home_score, cast((o_orderkey * 3 + o_custkey) % 9 as int) as away_score,
 cast(o_custkey % 25 as int) as venue_id, cast(40 + o_custkey % 60 as int) as temp_f
from orders"""

VIEWS["pitches_v"] = """
select l_orderkey as game_pk, at_bat_index, pitch_number,
 cast((l_orderkey * 5 + at_bat_index) % 41 as int) as pitcher_id, cast((l_orderkey + at_bat_index * 13) % 53 as int) as batter_id,
 cast(o_orderdate as date) as game_date, l_shipdate as pitch_ts,
 cast(l_partkey % 4 as int) as balls, cast(l_suppkey % 3 as int) as strikes, cast(l_partkey % 3 as int) as outs,
 cast(1 + at_bat_index as int) as inning, at_bat_index % 2 = 0 as top_inning,
 case cast((l_orderkey + at_bat_index) % 4 as int) when 0 then 'Empty' when 1 then 'Men_On' when 2 then 'RISP' else 'Loaded' end as men_on_base,
 case when ((l_orderkey + at_bat_index * 13) % 53) % 2 = 0 then 'R' else 'L' end as bat_side,
 case when ((l_orderkey * 5 + at_bat_index) % 41) % 3 = 0 then 'L' else 'R' end as pitch_hand,
 cast(1 + l_partkey % 120 as int) as pitch_of_game,
 case when l_tax = 0 then null else 80 + l_quantity / 2.5 end as start_speed,
 case when l_discount = 0 then null else cast(1 + l_partkey % 14 as int) end as zone,
 case cast(l_partkey % 5 as int) when 0 then 'ball' when 1 then 'called_strike' when 2 then 'swinging_strike' when 3 then 'foul' else 'in_play' end as description,
 case cast(l_partkey % 5 as int) when 0 then 'ball' when 4 then 'in_play' else 'strike_foul' end as result_category,
 l_partkey % 5 = 0 as is_ball, l_partkey % 5 = 4 as is_in_play,
 case cast(l_suppkey % 6 as int) when 0 then 'FF' when 1 then 'SI' when 2 then 'SL' when 3 then 'CH' when 4 then 'FC' else null end as pitch_type,
 case when l_partkey % 5 = 4 then 70 + l_quantity end as launch_speed,
 case when l_partkey % 5 = 4 then cast(l_suppkey % 60 as double) - 10 end as launch_angle
from (select s.*, cast(floor(seq / 3) as int) as at_bat_index, cast(seq % 3 as int) + 1 as pitch_number from
 (select l.*, o.o_orderdate, row_number() over (partition by l_orderkey
   order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 as seq
   from lineitem l join orders o on l.l_orderkey = o.o_orderkey) s) p"""

VIEWS["at_bats_v"] = """
select game_pk, at_bat_index, min(pitcher_id) as pitcher_id, min(batter_id) as batter_id, min(game_date) as game_date,
 cast(count(*) as int) as pitch_count, min(men_on_base) as men_on_base, min(bat_side) as bat_side, min(pitch_hand) as pitch_hand,
 case cast((game_pk * 3 + at_bat_index) % 9 as int) when 0 then 'strikeout' when 1 then 'walk' when 2 then 'hit' when 3 then 'hit' when 4 then 'hit' when 5 then 'hit' when 6 then 'walk' else 'out' end as result,
 case cast((game_pk * 3 + at_bat_index) % 9 as int) when 0 then 'strikeout' when 1 then 'walk' when 2 then 'single' when 3 then 'double' when 4 then 'triple' when 5 then 'home_run' when 6 then 'hit_by_pitch' when 7 then 'field_out' else 'sac_fly' end as result_detail
from pitches_v group by game_pk, at_bat_index"""

VIEWS["predictions_v"] = """
select game_pk * 1000 + at_bat_index * 20 + pitch_number * 2 + m.mid as id, game_pk, at_bat_index, pitch_number - 1 as pitch_number,
 game_date as created_date, m.market,
 case when m.mid = 0 then case cast((game_pk + pitch_number) % 3 as int) when 0 then 'ball' when 1 then 'strike_foul' else 'in_play' end
      else case when (game_pk + at_bat_index) % 2 = 0 then 'over' else 'under' end end as recommendation,
 case when m.mid = 1 then 90.5 else null end as line,
 case cast(game_pk % 3 as int) when 0 then -110 when 1 then 120 else null end as price,
 round(cast(0.4 as double) + ((game_pk + pitch_number) % 50) / cast(100 as double), 4) as confidence,
 case when game_pk % 5 = 0 then 'v1' else 'v2' end as model_version,
 (game_pk + pitch_number) % 11 = 0 as backfilled
from pitches_v cross join (select 0 as mid, 'pitch_result' as market union all select 1, 'pitch_speed_ou') m
where (game_pk + pitch_number + m.mid) % 7 <> 0"""

VIEWS["odds_v"] = """
select o_orderkey * 100 + s.sid * 10 + t.oid * 2 + n.n as id, o_orderkey as game_pk, 'game_moneyline' as market, s.source, t.outcome,
 cast(case when (o_orderkey + s.sid + t.oid + n.n) % 2 = 0 then -(100 + (o_orderkey * 7 + n.n * 13) % 150) else 100 + (o_orderkey * 11 + s.sid * 5) % 150 end as int) as price_american,
 case when n.n = 0 then o_orderdate else o_orderdate + interval '5' minute end as fetched_at
from orders cross join (select 0 as sid, 'espn' as source union all select 1, 'kalshi') s
 cross join (select 0 as oid, 'home' as outcome union all select 1, 'away') t
 cross join (select 0 as n union all select 1) n
where not (s.sid = 1 and t.oid = 1 and o_orderkey % 4 = 0)"""

VIEWS["ledger_v"] = """
select 'pitches' as dataset, game_date as day, count(*) as rows_n, count(distinct game_pk) as games from pitches_v group by game_date
union all select 'at_bats', game_date, count(*), count(distinct game_pk) from at_bats_v group by game_date
union all select 'games', game_date, count(*), count(*) from games_v where status = 'Final' group by game_date"""

BASE = ("orders", "lineitem", "events", "customer", "supplier", "part", "nation", "region")


def needed(sql: str) -> list[str]:
    """Derived tables that a query reads, in order of definition."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                todo.append(VIEWS[name])
    return [n for n in VIEWS if n in found]


def with_views(sql: str) -> str:
    """A query with the derived tables it reads as common table expressions."""
    sql = sql.strip()
    ctes = ", ".join(f"{n} as ({VIEWS[n]})" for n in needed(sql))
    if not ctes:
        return sql
    return f"with {ctes}, {sql[5:]}" if sql.lower().startswith("with ") else f"with {ctes} {sql}"


class Tables:
    """The tables of a folder; derived ones come as DataFrames on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        text = with_views(text)
        for name in BASE:
            if re.search(rf"\b{name}\b", text):
                self.base(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def __getattr__(self, name: str) -> DataFrame:
        if f"{name}_v" not in VIEWS:
            raise AttributeError(name)
        found = self.sql(f"select * from {name}_v")
        setattr(self, name, found)  # one frame a name, so that its exchanges can be used again
        return found
