"""Named clinical scores: weights by category of conditions, tiers and weights by source codes, and component counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import Score
from ..sources.cdm import Cdm

# Categories with weights and concepts.
CHARLSON = Score({
    "myocardial infarction": (1, (4329847,)),
    "congestive heart failure": (1, (316139,)),
    "peripheral vascular disease": (1, (321052,)),
    "cerebrovascular disease": (1, (381591, 434056)),
    "dementia": (1, (4182210,)),
    "chronic pulmonary disease": (1, (4063381,)),
    "rheumatologic disease": (1, (257628, 134442, 80800, 80809, 256197, 255348)),
    "peptic ulcer disease": (1, (4247120,)),
    "mild liver disease": (1, (4212540, 4064161)),
    "diabetes": (1, (201820,)),
    "diabetes with complications": (2, (443767, 442793)),
    "hemiplegia": (2, (192606, 374022)),
    "renal disease": (2, (4030518,)),
    "malignancy": (2, (443392,)),
    "moderate or severe liver disease": (3, (4245975, 4029488, 192680, 24966)),
    "metastatic tumor": (6, (432851,)),
    "aids": (6, (439727,)),
})
CHADS2 = Score({
    "heart failure": (1, (316139,)),
    "hypertension": (1, (316866,)),
    "diabetes": (1, (201820,)),
    "stroke": (2, (381591, 434056)),
}, ages=((75, 1),))
CHA2DS2_VASC = Score({
    "heart failure": (1, (316139, 314378, 318773, 321319)),
    "hypertension": (1, (320128, 442604, 201313)),
    "diabetes": (1, (201820, 442793)),
    "stroke": (2, (4043731, 4110192, 375557, 4108356, 373503, 434656, 433505, 376714, 312337)),
    "vascular disease": (1, (312327, 43020432, 314962, 312939, 315288, 317309, 134380, 196438, 200138, 194393, 319047, 40486130, 317003, 4313767, 321596, 317305, 321886, 314659, 321887, 437312, 134057)),
}, ages=((65, 1), (75, 2)), female=1)
#: Scores by name; those that count the age need a reference year.
SCORES: Mapping[str, Score] = {"charlson": CHARLSON, "chads2": CHADS2, "cha2ds2vasc": CHA2DS2_VASC}

# One point for each of these concepts or what lies below it, by index.
COMPONENTS: Mapping[str, Sequence[int]] = {
    "charlson": (4329847, 316139, 381591, 4182210, 4063381, 255573, 201820, 192671, 4030518, 443392, 4178338, 432851, 4212540, 439727),
    "dcsi": (443767, 4209145, 4271003, 321822, 4030518),
    "chads2": (316139, 320128, 201820, 381591, 313217),
    "cha2ds2vasc": (316139, 320128, 201820, 381591, 313217, 321822),
    "hfrs": (316139, 4182210, 201820, 192671, 198199),
}

# Diabetes complications severity, (category, tier, ICD-9-CM code patterns).
DCSI: Sequence[tuple[str, float, Sequence[str]]] = (
    ("retinopathy", 1, ("250.5%", "362.01", "362.1%", "362.83", "362.53", "362.81", "362.82")),
    ("retinopathy", 2, ("361%", "369%", "362.02", "379.23")),
    ("nephropathy", 1, ("250.4%", "580%", "581%", "582%", "583%")),
    ("nephropathy", 2, ("585%", "586%", "593.9%")),
    ("neuropathy", 1, ("356.9%", "250.6%", "358.1%", "951.0%", "951.1%", "951.3%", "713.5%", "357.2%", "596.54", "337.0%", "337.1%", "564.5%", "536.3%", "458.0%", "354%", "355%")),
    ("cerebrovascular", 1, ("435%",)),
    ("cerebrovascular", 2, ("431%", "433%", "434%", "436%")),
    ("cardiovascular", 1, ("440%", "411%", "413%", "414%", "429.2%")),
    ("cardiovascular", 2, ("410%", "427.1%", "427.3%", "427.4%", "427.5%", "412%", "428%", "441%", "440.23", "440.24")),
    ("peripheral vascular", 1, ("250.7%", "442.3%", "892.1%", "443.9%", "443.81")),
    ("peripheral vascular", 2, ("785.4%", "707.1%", "040.0%", "444.22")),
    ("metabolic", 2, ("250.1%", "250.2%", "250.3%")),
)
# Hospital frailty risk, ICD-10 category and its weight.
FRAILTY: Mapping[str, float] = {
    "F00": 7.1, "G81": 4.4, "G30": 4.0, "I69": 3.7, "R29": 3.6, "N39": 3.2, "F05": 3.2, "W19": 3.2, "S00": 3.2, "R31": 3.0, "B96": 2.9, "R41": 2.7, "R26": 2.6, "I67": 2.6, "R56": 2.6,
    "R40": 2.5, "S06": 2.5, "T83": 2.4, "S42": 2.3, "E87": 2.3, "M25": 2.3, "E86": 2.3, "R54": 2.2, "Z50": 2.1, "F03": 2.1, "W18": 2.1, "Z75": 2.0, "F01": 2.0, "S80": 2.0, "L03": 2.0,
    "H54": 1.9, "E53": 1.9, "Z60": 1.8, "G20": 1.8, "R55": 1.8, "S22": 1.8, "K59": 1.8, "N17": 1.8, "L89": 1.7, "Z22": 1.7, "B95": 1.7, "L97": 1.6, "R44": 1.6, "K26": 1.6, "I95": 1.6,
    "N19": 1.6, "A41": 1.6, "Z87": 1.5, "J96": 1.5, "X59": 1.5, "M19": 1.5, "G40": 1.5, "M81": 1.4, "S72": 1.4, "S32": 1.4, "E16": 1.4, "R94": 1.4, "N18": 1.4, "R33": 1.3, "R69": 1.3,
    "N28": 1.3, "R32": 1.2, "G31": 1.2, "Y95": 1.2, "S09": 1.2, "R45": 1.2, "G45": 1.2, "Z74": 1.1, "M79": 1.1, "W06": 1.1, "S01": 1.1, "A04": 1.1, "A09": 1.1, "J18": 1.1, "J69": 1.0,
    "R47": 1.0, "E55": 1.0, "Z93": 1.0, "R02": 1.0, "R63": 0.9, "H91": 0.9, "W10": 0.9, "W01": 0.9, "E05": 0.9, "M41": 0.9, "R13": 0.8, "Z99": 0.8, "U80": 0.8, "M80": 0.8, "K92": 0.8,
    "I63": 0.8, "N20": 0.7, "F10": 0.7, "Y84": 0.7, "R00": 0.7, "J22": 0.7, "Z73": 0.6, "R79": 0.6, "Z91": 0.5, "S51": 0.5, "F32": 0.5, "M48": 0.5, "E83": 0.4, "M15": 0.4, "D64": 0.4,
    "L08": 0.4, "R11": 0.3, "K52": 0.3, "R50": 0.1,
}
HFRS: Sequence[tuple[str, float, Sequence[str]]] = tuple((code, weight, (f"{code}%",)) for code, weight in FRAILTY.items())


def code_score(cdm: Cdm, entries: Sequence[tuple[str, float, Sequence[str]]], codes: DataFrame) -> DataFrame:
    """(person_id, score): for each category the greatest weight of the codes a person has, summed; 0 for none.

    codes has concept_id and concept_code of source concepts; a pattern is a
    code, or the beginning of codes with a % after it.  A condition counts if
    it is such a concept, or one that it maps to.
    """
    rows = [(category, float(weight), pattern.rstrip("%"), pattern.endswith("%")) for category, weight, patterns in entries for pattern in patterns]
    listed = cdm.spark.createDataFrame(rows, "category string, weight double, head string, open boolean")
    # Each code by all its beginnings, so that patterns are met by an equal join.
    heads = codes.where("concept_code <> ''").select("concept_id", "concept_code", F.explode(F.expr("transform(sequence(1, length(concept_code)), n -> substring(concept_code, 1, n))")).alias("head"))
    coded = heads.join(F.broadcast(listed), "head").where("open OR concept_code = head").select(F.col("concept_id").alias("source"), "category", "weight")
    maps = cdm.concept_relationship.where("relationship_id = 'Maps to' AND invalid_reason IS NULL").select(F.col("concept_id_1").alias("source"), F.col("concept_id_2").alias("concept_id"))
    wanted = coded.join(maps, "source").select("concept_id", "category", "weight").unionByName(coded.withColumnRenamed("source", "concept_id"))
    wanted = wanted.groupBy("concept_id", "category").agg(F.max("weight").alias("weight"))
    had = cdm.condition_occurrence.select("person_id", F.col("condition_concept_id").alias("concept_id")).distinct()
    points = had.join(wanted, "concept_id").groupBy("person_id", "category").agg(F.max("weight").alias("w")).groupBy("person_id").agg(F.sum("w").alias("w"))
    return cdm.person.select("person_id").join(points, "person_id", "left").select("person_id", F.coalesce("w", F.lit(0.0)).alias("score"))


def component_index(cdm: Cdm, persons: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """(subject_id, score): how many of the seeds a person has a condition of, or below, at any time."""
    listed = cdm.spark.createDataFrame([(int(s), int(s)) for s in seeds], "seed long, condition_concept_id long")
    below = cdm.concept_ancestor.join(F.broadcast(listed.select("seed")), F.col("ancestor_concept_id") == F.col("seed")).select("seed", F.col("descendant_concept_id").alias("condition_concept_id"))
    wanted = listed.unionByName(below).distinct()
    had = cdm.condition_occurrence.select(F.col("person_id").alias("subject_id"), "condition_concept_id").distinct().join(wanted, "condition_concept_id")
    points = had.groupBy("subject_id").agg(F.countDistinct("seed").alias("n"))
    return persons.select("subject_id").distinct().join(points, "subject_id", "left").select("subject_id", F.coalesce("n", F.lit(0)).cast("long").alias("score"))
