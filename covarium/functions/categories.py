"""Category dictionaries and their look-up."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from covarium.functions.text import normalize_key

# Raw value -> label, in the form that the look-up normalises values to.
CAREGIVER = {
    "md": "physician",
    "mds": "physician",
    "mcd": "physician",
    "imd": "physician",
    "drm": "physician",
    "dml": "physician",
    "res": "med_student",
    "medres": "med_student",
    "med_st": "med_student",
    "medst": "med_student",
    "ms": "med_student",
    "ms_v": "med_student",
    "msiv": "med_student",
    "msv": "med_student",
    "hms_iv": "med_student",
    "hms_ms": "med_student",
    "hmsiv": "med_student",
    "mswint": "med_student",
    "rn": "nurse",
    "rnba": "nurse",
    "rnc": "nurse",
    "rncm": "nurse",
    "rns": "nurse",
    "nurse": "nurse",
    "nurs": "nurse",
    "srn": "nurse",
    "ccrn": "nurse",
    "np": "nurse_practitioner",
    "nnp": "nurse_practitioner",
    "snnp": "nurse_practitioner",
    "snp": "nurse_practitioner",
    "sn": "nursing_student",
    "stn": "nursing_student",
    "stnrs": "nursing_student",
    "stnuiv": "nursing_student",
    "stnur": "nursing_student",
    "stnurs": "nursing_student",
    "studen": "nursing_student",
    "stunur": "nursing_student",
    "rnstu": "nursing_student",
    "nstude": "nursing_student",
    "nsv": "nursing_student",
    "na": "nurse_aide",
    "pca": "nurse_aide",
    "pct": "nurse_aide",
    "ua": "nurse_aide",
    "uc": "nurse_aide",
    "uco": "nurse_aide",
    "rrt": "resp_therapy",
    "rrts": "resp_therapy",
    "rt": "resp_therapy",
    "rth": "resp_therapy",
    "rts": "resp_therapy",
    "crt": "resp_therapy",
    "srt": "resp_therapy",
    "rtstu": "resp_therapy",
    "pa": "physician_assistant",
    "pharmd": "pharmacy",
    "rph": "pharmacy",
    "sw": "social_work",
    "sw_int": "social_work",
    "swint": "social_work",
    "licsw": "social_work",
    "pt": "rehab",
    "rehab": "rehab",
    "otr/l": "rehab",
    "rd": "dietitian",
    "rd,ldn": "dietitian",
    "rd/ldn": "dietitian",
    "ms,rd": "dietitian",
    "cm": "coordinator",
    "co-ord": "coordinator",
    "co-wkr": "coordinator",
    "cowker": "coordinator",
    "cowkr": "coordinator",
    "cowork": "coordinator",
    "co-op": "coordinator",
    "coopst": "coordinator",
    "phd": "phd",
}
RELIGION = {
    "baptist": "protestant",
    "episcopalian": "protestant",
    "lutheran": "protestant",
    "methodist": "protestant",
    "protestant_quaker": "protestant",
    "7th_day_adventist": "protestant",
    "catholic": "catholic",
    "greek_orthodox": "orthodox",
    "romanian_east._orth": "orthodox",
    "christian_scientist": "other_christian",
    "unitarian-universalist": "other_christian",
    "jehovah's_witness": "other_christian",
    "jewish": "jewish",
    "hebrew": "jewish",
    "muslim": "muslim",
    "buddhist": "eastern",
    "hindu": "eastern",
    "not_specified": "unknown",
    "unobtainable": "unknown",
    "other": "unknown",
}
LANGUAGE = {
    "engl": "english",
    "amer": "asl",
    "span": "spanish",
    "*spa": "spanish",
    "port": "portuguese",
    "cape": "portuguese",
    "ptun": "portuguese",
    "*cre": "portuguese",
    "*chi": "chinese",
    "*can": "chinese",
    "cant": "chinese",
    "mand": "chinese",
    "*man": "chinese",
    "russ": "russian_ee",
    "*rus": "russian_ee",
    "*bos": "russian_ee",
    "serb": "russian_ee",
    "*bul": "russian_ee",
    "*lit": "russian_ee",
    "*rom": "russian_ee",
    "*hun": "russian_ee",
    "alba": "russian_ee",
    "poli": "russian_ee",
    "hind": "south_asian",
    "*ben": "south_asian",
    "beng": "south_asian",
    "*guj": "south_asian",
    "*nep": "south_asian",
    "*pun": "south_asian",
    "*tam": "south_asian",
    "*tel": "south_asian",
    "*urd": "south_asian",
    "urdu": "south_asian",
    "viet": "se_asian",
    "camb": "se_asian",
    "*khm": "se_asian",
    "laot": "se_asian",
    "*bur": "se_asian",
    "*fil": "se_asian",
    "*phi": "se_asian",
    "taga": "se_asian",
    "thai": "se_asian",
    "japa": "east_asian",
    "kore": "east_asian",
    "arab": "mideast",
    "*ara": "mideast",
    "*leb": "mideast",
    "*far": "mideast",
    "*per": "mideast",
    "pers": "mideast",
    "turk": "mideast",
    "*mor": "mideast",
    "hait": "haitian_creole",
    "fren": "french",
    "ethi": "african",
    "*amh": "african",
    "soma": "african",
    "*ful": "african",
    "*ibo": "african",
    "*yor": "african",
    "*toi": "african",
    "*toy": "african",
    "germ": "european_other",
    "gree": "european_other",
    "ital": "european_other",
    "*dut": "european_other",
    "*arm": "european_other",
    "*yid": "european_other",
    "**_t": "unknown",
    "**sh": "unknown",
    "**to": "unknown",
    "*_be": "unknown",
    "*_fu": "unknown",
    "*cdi": "unknown",
    "*dea": "unknown",
}
ETHNICITY = {
    "white": "white",
    "white_-_brazilian": "white",
    "white_-_eastern_european": "white",
    "white_-_other_european": "white",
    "white_-_russian": "white",
    "portuguese": "white",
    "black/african_american": "black",
    "black/african": "black",
    "black/cape_verdean": "black",
    "black/haitian": "black",
    "caribbean_island": "black",
    "hispanic_or_latino": "latinx",
    "hispanic/latino_-_puerto_rican": "latinx",
    "hispanic/latino_-_dominican": "latinx",
    "hispanic/latino_-_mexican": "latinx",
    "hispanic/latino_-_central_american_(other)": "latinx",
    "hispanic/latino_-_guatemalan": "latinx",
    "hispanic/latino_-_honduran": "latinx",
    "hispanic/latino_-_salvadoran": "latinx",
    "hispanic/latino_-_colombian": "latinx",
    "hispanic/latino_-_cuban": "latinx",
    "south_american": "latinx",
    "asian": "asian",
    "asian_-_chinese": "asian",
    "asian_-_asian_indian": "asian",
    "asian_-_vietnamese": "asian",
    "asian_-_cambodian": "asian",
    "asian_-_filipino": "asian",
    "asian_-_japanese": "asian",
    "asian_-_korean": "asian",
    "asian_-_thai": "asian",
    "asian_-_other": "asian",
    "middle_eastern": "middle_eastern",
    "american_indian/alaska_native": "native",
    "american_indian/alaska_native_federally_recognized_tribe": "native",
    "native_hawaiian_or_other_pacific_islander": "pi",
    "multi_race_ethnicity": "multiracial",
    "other": "unknown",
    "patient_declined_to_answer": "unknown",
    "unable_to_obtain": "unknown",
}

DICTIONARIES = {"caregiver_role": CAREGIVER, "religion": RELIGION, "language": LANGUAGE, "ethnicity": ETHNICITY}


def recode(value: Column, mapping: dict[str, str], default: str = "unknown", key=normalize_key) -> Column:
    """Look-up of the normalised value in a dictionary of fixed size; null and unlisted values give the default."""
    lookup = F.create_map(*map(F.lit, chain.from_iterable(mapping.items())))
    return F.coalesce(F.try_element_at(lookup, key(value)), F.lit(default))


def caregiver_title(value: Column) -> Column:
    """The stand-alone form: stripped and lower-cased only, `other` by default."""
    return recode(value, DICTIONARIES["caregiver_role"], "other", lambda v: F.lower(F.regexp_replace(v, r"^\s+|\s+$", "")))


def religion(value: Column) -> Column:
    return recode(value, DICTIONARIES["religion"])


def language(value: Column) -> Column:
    return recode(value, DICTIONARIES["language"])


def ethnicity(value: Column) -> Column:
    return recode(value, DICTIONARIES["ethnicity"])
