"""Ordered rules from registry texts to asset classes: the first rule that matches decides.

Rules are a constant of the library, so they become one CASE beside the scan rather than a
join. Texts are compared folded, as substrings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from atrisk.functions.norm import folded, let

Rules = list[tuple[tuple[str, ...], str]]

# Types of social services; any of the words.
SOCIAL: Rules = [
    (("residencia assistida", "llar residencia", "residencial"), "care_home"),
    (("centre de dia",), "day_centre"),
    (("discapacitat",), "disability_home"),
    (("acolliment residencial", "exclusio social", "urgencia"), "shelter"),
    (("infants", "adolescents"), "childcare_residential"),
    (("malaltia mental", "salut mental"), "mental_health"),
]

# Kinds of schools; all of the words.
SCHOOLS: Rules = [
    (("infantil", "primari", "secundari"), "school"),
    (("infantil", "primari"), "primary_school"),
    (("primari", "secundari"), "school"),
    (("infantil",), "nursery"),
    (("conservatori",), "music_school"),
    (("music",), "music_school"),
    (("danza",), "music_school"),
    (("dansa",), "music_school"),
    (("arte dramatico",), "music_school"),
    (("artes plasticas",), "music_school"),
    (("idiomas",), "vocational"),
    (("idiomes",), "vocational"),
    (("adultos",), "vocational"),
    (("adultes",), "vocational"),
    (("adults",), "vocational"),
    (("personas adultas",), "vocational"),
    (("formacion profesional",), "vocational"),
    (("formacio profesional",), "vocational"),
    (("deportiv",), "vocational"),
    (("secundari",), "secondary_school"),
    (("institut",), "secondary_school"),
    (("bachillerato",), "secondary_school"),
    (("primari",), "primary_school"),
    (("colegio rural agrupado",), "primary_school"),
    (("universidad",), "university"),
    (("biblioteca",), "library"),
]

# Categories of public facilities; any of the words.
FACILITIES: Rules = [
    (("atencio primaria",), "primary_care"),
    (("hospital",), "hospital"),
    (("centres sociosanitaris", "salut mental"), "mental_health"),
    (("farmacia", "farmacies"), "pharmacy"),
    (("centres sanitaris", "salut"), "clinic"),
    (("bombers",), "fire_station"),
    (("policia", "mossos", "guardia urbana"), "police"),
    (("proteccio civil",), "civil_protection"),
    (("recerca",), "research"),
    (("universitats",), "university"),
    (("educacio infantil de 1r cicle", "llars d infants", "escoles bressol"), "nursery"),
    (("educacio primaria",), "primary_school"),
    (("educacio secundaria", "batxillerat"), "secondary_school"),
    (("educacio infantil",), "nursery"),
    (("escoles de musica", "escoles d art", "conservatori", "escoles de dansa"), "music_school"),
    (("formacio de persones adultes", "formacio professional", "ensenyaments"), "vocational"),
    (("biblioteques",), "library"),
    (("arxius",), "archive"),
    (("formacio", "educacio"), "school"),
    (("installacions esportives", "instalacions esportives", "poliesportiu", "pavello", "piscina", "rocodrom", "padel", "esports"), "sports_facility"),
    (("museus", "colleccions", "centres d interpretacio"), "museum"),
    (("esglesies", "ermites", "monestirs", "santuaris"), "church"),
    (("castells",), "castle"),
    (("jaciments", "arqueolog"), "archaeological"),
    (("monuments",), "monument"),
    (("aeroports", "aerodroms", "heliports"), "airport"),
    (("estacions",), "station"),
    (("ports",), "port"),
    (("inspeccio tecnica de vehicles", "itv"), "workshop"),
    (("campings",), "campsite"),
    (("albergs",), "hostel"),
    (("cases de colonies", "turisme rural"), "rural_lodging"),
    (("hotels",), "hotel"),
    (("oficines de turisme",), "attraction"),
    (("deixalleries",), "waste_facility"),
    (("depuradores",), "wastewater"),
    (("parcs naturals", "espais naturals"), "protected_area"),
    (("parcs", "jardins"), "park"),
    (("mercats",), "market"),
    (("cinemes", "espais escenics", "teatres", "auditoris", "espais d arts visuals", "centres culturals", "ateneus", "casals", "cases de cultura", "equipaments civics", "altres espais aptes", "cultura"), "attraction"),
    (("oficines", "ajuntaments", "ens locals", "administracio", "registres", "habitatge", "treball", "consells comarcals", "generalitat"), "office"),
    (("cementiris", "tanatoris"), "other"),
    (("punt tic", "tecnologia"), "office"),
]


def first_rule(text: Column, rules: Rules, every: bool = False) -> Column:
    """The class of the first rule of which the folded text holds any word (or every one);
    null where none matches or the text is null."""
    both = (lambda a, b: a & b) if every else (lambda a, b: a | b)
    return F.coalesce(*(F.when(reduce(both, map(text.contains, words)), name) for words, name in rules))


def social_service(kind: Column) -> Column:
    """Null for services that are no premises; a home that names disability and not the
    elderly is a disability home."""
    home = lambda text, found: F.when((found == "care_home") & text.contains("discapacitat") & ~text.contains("gent gran"), "disability_home").otherwise(found)
    return let(folded(kind), lambda text: let(first_rule(text, SOCIAL), lambda found: home(text, found)))


def facility(category: Column, name: Column) -> Column:
    """By the category, else by the name, else ``other``."""
    found = lambda c: let(folded(c), lambda text: first_rule(text, FACILITIES))
    return F.coalesce(found(category), found(name), F.lit("other"))


def school(kind: Column, name: Column) -> Column:
    """By the kind, where that is blank by the name; a plain school if nothing matches."""
    text = F.coalesce(F.nullif(folded(kind), F.lit("")), folded(name))
    return F.coalesce(let(text, lambda t: first_rule(t, SCHOOLS, every=True)), F.lit("school"))


def display_name(kind: Column, name: Column, locality: Column) -> Column:
    """The name, with its kind before it where it is missing or only the locality's."""
    plain = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(""))
    bare = (plain == "") | F.coalesce(folded(plain) == folded(locality), F.lit(False))
    kind = F.coalesce(F.trim(kind), F.lit(""))
    return F.nullif(F.when(bare & (kind != ""), F.trim(F.concat_ws(" ", kind, plain))).otherwise(plain), F.lit(""))


def school_level(flags: dict[str, Column], name: Column) -> Column:
    """By the stages a school offers (``infant``, ``primary``, ``secondary``, ``upper``) and
    words of its name."""
    on = {k: F.coalesce(F.lower(F.trim(c)).isin("s", "si", "sí", "1", "true", "x"), F.lit(False)) for k, c in flags.items()}
    text = F.coalesce(folded(name), F.lit(""))
    has = lambda *words: reduce(lambda a, b: a | b, map(text.contains, words))
    return (
        F.when(has("llar d infants", "llar infants", "escola bressol"), "nursery")
        .when(on["secondary"] | on["upper"], "secondary_school")
        .when(on["primary"], "primary_school")
        .when(on["infant"], "nursery")
        .when(has("universitat"), "university")
        .when(has("adults", "formacio", "fp ", "oficis"), "vocational")
        .when(has("musica", "dansa"), "music_school")
        .otherwise("school")
    )
