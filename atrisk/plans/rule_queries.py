"""Registered queries of the rule-based registry jobs, over parts with words of the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrisk.functions import rules
from atrisk.plans.inventory_queries import _FOLD
from atrisk.plans.registry import query
from atrisk.sources import fixtures as fx

NAMES = ["Escola bressol Sol", "Universitat Nova", "Centre d'Adults", "Escola de Música", "Col·legi Mar", "FP Oficis"]


def _table(table: rules.Rules) -> str:
    """The rules as rows, of which the oracle takes the first by number."""
    return "(select * from (values " + ", ".join(f"({i}, [{', '.join(repr(w) for w in words)}], '{name}')" for i, (words, name) in enumerate(table)) + ") r(n, words, class))"


def _phrases(table: rules.Rules) -> list[str]:
    return [w.title() for words, _ in table for w in (*words, " i ".join(words))] + ["Sense Regla"]


def _pick(values, k):
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def _sql_pick(values, k) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({k}) % {len(values)} + 1]"


def _first(text: str, table: rules.Rules, every: bool) -> str:
    """A query of k and class over p(k, text)."""
    hits = f"len(list_filter(words, lambda w: contains({text}, w)))"
    return f"select k, min_by(class, n) as class from p, {_table(table)} where {hits} {'= len(words)' if every else '> 0'} group by 1"


_SOCIAL = f"p as (select p_partkey as k, {_sql_pick(_phrases(rules.SOCIAL), 'p_partkey')} || case p_partkey % 3 when 0 then ' gent gran' when 1 then ' Discapacitat' else '' end as t from part), f as (select k, {_FOLD('t')} as t from p)"


@query("n8_social_services", f"with {_SOCIAL}, m as ({_first('t', rules.SOCIAL, False).replace('from p,', 'from f,')}) select f.k, case when class = 'care_home' and contains(t, 'discapacitat') and not contains(t, 'gent gran') then 'disability_home' else class end as class from f join m on f.k = m.k")
def n8(spark, sf_dir):
    k = F.col("p_partkey")
    kind = F.concat(_pick(_phrases(rules.SOCIAL), k), F.when(k % 3 == 0, " gent gran").when(k % 3 == 1, " Discapacitat").otherwise(""))
    # services without premises are dropped
    return fx.read(spark, sf_dir, "part").select(k.alias("k"), rules.social_service(kind).alias("class")).filter("class is not null")


@query("n9_public_facilities", f"with s as (select p_partkey as k, case when p_partkey % 4 > 0 then {_sql_pick(_phrases(rules.FACILITIES), 'p_partkey')} end as c, case when p_partkey % 8 < 4 then {_sql_pick(_phrases(rules.FACILITIES), 'p_partkey * 7')} end as n from part), p as (select k, {_FOLD('c')} as t from s), q as (select k, {_FOLD('n')} as t from s), a as ({_first('t', rules.FACILITIES, False)}), b as ({_first('t', rules.FACILITIES, False).replace('from p,', 'from q,')}) select s.k, coalesce(a.class, b.class, 'other') as class from s left join a on s.k = a.k left join b on s.k = b.k")
def n9(spark, sf_dir):
    k, phrases = F.col("p_partkey"), _phrases(rules.FACILITIES)
    category, name = F.when(k % 4 > 0, _pick(phrases, k)), F.when(k % 8 < 4, _pick(phrases, k * 7))
    return fx.read(spark, sf_dir, "part").select(k.alias("k"), rules.facility(category, name).alias("class"))


_SCHOOLS = f"(select p_partkey as k, case when p_partkey % 3 > 0 then {_sql_pick(_phrases(rules.SCHOOLS), 'p_partkey')} else ' ' end as kind, case when p_partkey % 5 = 0 then null when p_partkey % 5 = 1 then 'Sant Pau' else {_sql_pick(_phrases(rules.SCHOOLS), 'p_partkey * 5')} end as name from part)"


@query("n15_national_schools", f"with s as (select * from {_SCHOOLS}), p as (select k, coalesce(nullif({_FOLD('kind')}, ''), {_FOLD('name')}) as t from s), m as ({_first('t', rules.SCHOOLS, True)}) select s.k, coalesce(class, 'school') as class, nullif(case when (name is null or name = 'Sant Pau') and trim(kind) <> '' then trim(trim(kind) || ' ' || coalesce(name, '')) else coalesce(name, '') end, '') as name from s left join m on s.k = m.k")
def n15(spark, sf_dir):
    k, phrases = F.col("p_partkey"), _phrases(rules.SCHOOLS)
    kind = F.when(k % 3 > 0, _pick(phrases, k)).otherwise(" ")
    name = F.when(k % 5 == 1, "Sant Pau").when(k % 5 != 0, _pick(phrases, k * 5))
    return fx.read(spark, sf_dir, "part").select(k.alias("k"), rules.school(kind, name).alias("class"), rules.display_name(kind, name, F.lit("sant pau")).alias("name"))


# By name 0 is a nursery whatever its stages; what has no stage goes by its name's words.
@query("n7_regional_schools", "with s as (select p_partkey as k, p_partkey % 6 as n, p_partkey % 11 as f from part) select k, case when n = 0 then 'nursery' when f in (1, 2) then 'secondary_school' when f = 3 then 'primary_school' when f = 4 then 'nursery' else ['university', 'vocational', 'music_school', 'school', 'vocational'][n] end as class from s")
def n7(spark, sf_dir):
    k = F.col("p_partkey")
    f = k % 11
    flags = {"secondary": F.when(f == 1, " S "), "upper": F.when(f == 2, "sí"), "primary": F.when(f.isin(1, 3), "1"), "infant": F.when(f == 4, "X").when(f == 5, "no")}
    return fx.read(spark, sf_dir, "part").select(k.alias("k"), rules.school_level(flags, _pick(NAMES, k)).alias("class"))
