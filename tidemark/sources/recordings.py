"""Recordings of a cohort: channels by their canonical names, at one rate, read once.

What can fail is checked in this order: parameters, the root, ids, files, headers, channels, samples. Parameters
and the root raise on the driver; a recording's own failure is a row with its error, and the others go on.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.settings import expand
from ..operators.fits import line_noise
from ..session import ship
from . import edf
from .errors import ChannelResolutionError, DataLoadError, FolderNotFoundError, InvalidSubjectIDError, RootError, SourceError

# fixed values: canonical channels with their labels in files, the first the most wanted, in all spellings that are
# known, for those who match them with regard to case
ALIASES: list[tuple[str, list[str]]] = [
    ("F3", ["F3M2", "F3A2", "F3-M2", "EEG F3-A2", "FZM2", "FZA2", "FP1M2", "FP1A2", "F7M2", "F7A2", "F3:M2", "F3"]),
    ("F4", ["F4M1", "F4A1", "F4-M1", "EEG F4-A1", "FZM2", "FZA2", "FP2M1", "FP2A1", "F8M1", "F8A1", "F4:M1", "F4"]),
    ("C3", ["C3M2", "C3A2", "C3-M2", "EEG C3-A2", "C3M1", "CZM2", "C3:M2", "C3"]),
    ("C4", ["C4M1", "C4A1", "C4-M1", "EEG C4-A1", "C4M2", "CZM2", "C4:M1", "C4"]),
    ("O1", ["O1M2", "O1A2", "O1-M2", "EEG O1-A2", "O1M1", "O1:M2", "O1"]),
    ("O2", ["O2M1", "O2A1", "O2-M1", "EEG O2-A1", "O2M2", "O2:M1", "O2"]),
    ("A1A2", ["A1A2", "M1M2", "EEG A1-A2", "EEG M1-M2"]),
    ("LEOG", ["LOC", "LEOG", "E1-M2", "EOG LOC-A2", "EOG1:M2", "E1"]),
    ("REOG", ["ROC", "REOG", "E2-M2", "EOG ROC-A1", "EOG ROC-A2", "EOG2:M1", "E2"]),
    ("Chin", ["Chin", "CHIN", "chin", "emg_Chin", "EMG", "CHINEMG", "ChinEMG", "EMG Chin", "Chin1-Chin2", "Chin 1-Chin 2", "ChinL", "Chin-L", "ChinR", "Chin-R"]),
    ("ECG", ["ECG", "EKG", "ECG1-ECG2"]),
    ("LLeg", ["LLeg", "LLEG", "emg_LLeg", "LEMG", "L EMG", "LLEGEMG", "LEG/L", "Left Leg", "L-Leg 1-L-Leg 2", "Leg-L", "Leg 1", "LAT", "Leg/L", "LEG1"]),
    ("RLeg", ["RLeg", "RLEG", "emg_RLeg", "R EMG", "RLEGEMG", "LEG/R", "Right Leg", "R-Leg1-R-Leg2", "Leg-R", "Leg 2", "RAT", "Leg/R", "LEG2", "LEMG"]),
    ("LArm", ["L-Arm", "ARMLeft", "LArm"]),
    ("RArm", ["R-Arm", "ARMRight", "RArm"]),
    ("PFlow", ["PFlo", "Pflo", "PFLO", "flow_PFlo", "PTAF", "Nasal Pressure", "PAP Flow", "Pflow", "PFlow", "Ptaf", "Flow Patient"]),
    ("TFlow", ["TFlo", "Tflo", "TFLO", "flow_TFlo", "Flow", "Thermistor", "FLOW", "Thermist", "Airflow", "Therm", "Flow Patient"]),
    ("CFlow", ["CFlo", "Cflo", "CFLO", "flow_CFlo", "VFLOW", "CFlow", "PAP Flow", "CPAP Flow", "Flow Patient"]),
    ("Thorax", ["Tho", "THO", "Thorax", "Thor", "THOR", "Effort THO"]),
    ("Abdomen", ["Abd", "ABD", "Abdomen", "Abdo", "ABDM", "Effort ABD"]),
    ("SpO2", ["SpO2", "SAO2"]),
    ("Snoring", ["SNOR", "Snore", "PSNO", "SNORE", "MICR", "Snoring", "Micr", "Micro", "Snoring Sensor"]),
    ("Position", ["POS", "Body", "BODY", "Manual Pos", "ManPosition", "Body Position"]),
    ("CPAP", ["CPAP", "VPAP", "CPress", "PAP Press", "CPAP Pressure", "PressCheck"]),
    ("IPAP", ["IPAP", "xPAP IPAP", "CPAP IPAP"]),
    ("EPAP", ["EPAP", "xPAP EPAP", "CPAP EPAP"]),
    ("Leak", ["Leak", "PAP Leak", "Leak Total", "CPAP Leak", "LEAK"]),
    ("PPG", ["PPG", "Pleth", "Plethysmogram"]),
    ("Pulse", ["Pulse", "PulseRate", "PulseR", "PULSE", "HR"]),
    ("RR", ["RR", "rr"]),
    ("IntercostalEMG", ["ICOSEMG", "INT 1", "InterEMG", "EMG1", "INT"]),
    ("Impedance", ["imp"]),
    ("CO2", ["CO2", "pCo2", "EtCO2", "ECO2", "EtCO", "CO2_Flow", "tCO2", "mmHG", "mmHg"]),
]
LOADED = (
    "subject_id string, position int, channel string, physical string, sf double, samples array<double>, missing array<string>, "
    "unresolved array<string>, conflicts array<struct<canonical:string,alias:string,physical:string,claimed_by:string>>, error_type string, error_message string"
)


def safe_id(c: Column | str) -> Column:
    """Whether an id may name a file: not empty, not padded, no separators, no "..", no NUL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce((F.length(F.trim(c)) > 0) & (F.trim(c) == c) & ~c.rlike(r"[/\\\x00]|[.][.]"), F.lit(False))


def root_folder(variable: str, below: str = "") -> str:
    """The folder that a variable of the environment names, or one below it."""
    if not (root := os.environ.get(variable, "").strip()):
        raise RootError(f"${variable} is not set")
    path = os.path.join(expand(root), below) if below else expand(root)
    if "://" not in path and not os.path.isdir(path):
        raise FolderNotFoundError(f"no folder {path}")
    return path


def claim(labels: list[str], aliases: list[tuple[str, list[str]]], ignore_case: bool = True) -> tuple[dict, list, list, list]:
    """Of one recording's labels: resolved, missing, conflicts and unresolved, as relational.resolve_channels finds them."""
    norm = (lambda s: s.strip().lower()) if ignore_case else str.strip
    physical = {norm(x): x for x in reversed(labels)}
    resolved, missing, conflicts, owner = {}, [], [], {}
    for canonical, names in aliases:
        there = [(a, physical[norm(a)]) for a in names if norm(a) in physical]
        free = next((k for k, (_, x) in enumerate(there) if x not in owner), len(there))
        conflicts += [{"canonical": canonical, "alias": a, "physical": x, "claimed_by": owner[x]} for a, x in there[:free]]
        if free < len(there):
            resolved[canonical] = there[free][1]
            owner[there[free][1]] = canonical
        elif not there:
            missing.append(canonical)
    return resolved, missing, conflicts, [c for c, _ in aliases if c not in resolved]


@dataclass(frozen=True)
class Recordings:
    """How a cohort's recordings are read.

    ``rate`` resamples all channels and cuts them to the shortest; without it they must have equal lengths.
    ``mains`` is the frequency of a band-stop, or none. ``reader`` (contents, labels) gives (label, rate, values) in
    place of the built-in EDF reader, ``lister`` (contents) the labels; with a reader of one's own there is no ``rate``.
    """

    aliases: list[tuple[str, list[str]]] | None = None
    requested: list[str] | None = None
    strict: bool = False
    ignore_case: bool = True
    rate: float | None = None
    mains: float | None = 60.0
    reader: Callable | None = None
    lister: Callable | None = None

    def __post_init__(self):
        table = ALIASES if self.aliases is None else self.aliases
        if not table:
            raise ValueError("the table of aliases is empty")
        if self.rate is not None and not self.rate > 0:
            raise ValueError("rate must be positive")
        if self.mains is not None and not self.mains > 0:
            raise ValueError("mains must be positive or None")
        if self.rate is not None and self.reader is not None:
            raise ValueError("rate and a reader of one's own exclude each other")
        known = dict(table)
        if unknown := [c for c in self.requested or [] if c not in known]:
            raise ChannelResolutionError(f"unknown channels: {', '.join(unknown)}")

    @property
    def wanted(self) -> list[tuple[str, list[str]]]:
        """The canonical channels in their order, with their aliases."""
        table = ALIASES if self.aliases is None else self.aliases
        return table if self.requested is None else [(c, dict(table)[c]) for c in self.requested]

    def load_one(self, contents: bytes) -> list[dict]:
        """The rows of one recording."""
        labels = self.lister(contents) if self.lister else edf.labels(contents)
        resolved, missing, conflicts, unresolved = claim(labels, self.wanted, self.ignore_case)
        if self.strict and unresolved:
            raise ChannelResolutionError(f"no channel for {', '.join(unresolved)}")
        found = {label: (rate, K.one_dimension(x, label)) for label, rate, x in (self.reader or edf.parse_signals)(contents, list(resolved.values()))}
        if lost := [x for x in resolved.values() if x not in found]:
            raise DataLoadError(f"no samples of {', '.join(lost)}")
        signals = {c: found[x] for c, x in resolved.items()}
        if self.rate is not None:
            stacked = K.resample_channels([x for _, x in signals.values()], [r for r, _ in signals.values()], self.rate)
            signals = {c: (self.rate, x) for c, x in zip(signals, stacked, strict=True)}
        elif len({len(x) for _, x in signals.values()}) > 1:
            raise DataLoadError("channels differ in length: " + ", ".join(f"{c} {len(x)}" for c, (_, x) in signals.items()))
        if self.mains is not None:
            signals = {c: (r, line_noise(self.mains)(x, r)) if r > 2 * self.mains + 1 else (r, x) for c, (r, x) in signals.items()}
        common = {"missing": missing, "unresolved": unresolved, "conflicts": conflicts, "error_type": None, "error_message": None}
        rows = [{"position": k, "channel": c, "physical": resolved[c], "sf": float(r), "samples": np.asarray(x, float)} | common for k, (c, (r, x)) in enumerate(signals.items())]
        return rows or [dict.fromkeys(("position", "channel", "physical", "sf", "samples")) | common | {"error_type": "ChannelResolutionError", "error_message": "none of the wanted channels is there"}]

    def load(self, files: DataFrame) -> DataFrame:
        """LOADED rows of files (subject_id, content, and other columns, which stay); a file is read once, its failure is a row."""
        ship(files.sparkSession)
        rest = [f for f in files.schema.fields if f.name not in ("subject_id", "content")]
        schema = LOADED + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rest)
        names = [c.split(" ")[0] for c in ("subject_id", "position", "channel", "physical", "sf", "samples", "missing", "unresolved", "conflicts", "error_type", "error_message")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.to_dict("records"):
                    try:
                        rows = self.load_one(r["content"])
                    except Exception as problem:  # this recording's; the others go on
                        kind = type(problem).__name__ if isinstance(problem, SourceError) and type(problem) is not SourceError else "DataLoadError"
                        rows = [dict.fromkeys(names) | {"error_type": kind, "error_message": str(problem)}]
                    more = {"subject_id": r["subject_id"]} | {f.name: r[f.name] for f in rest}
                    yield pd.DataFrame([x | more for x in rows], columns=[*names, *(f.name for f in rest)])

        return files.mapInPandas(run, schema)

    def with_requested(self, channels: list[str]) -> Recordings:
        return replace(self, requested=list(channels))


def one_channel(loaded: DataFrame, canonical: str, strict: bool = False) -> DataFrame:
    """The rows of one channel by its canonical name; with ``strict`` a recording that was read and lacks it raises."""
    own = loaded.filter(F.col("channel") == canonical)
    if strict and (lost := loaded.filter(F.col("channel").isNotNull()).select("subject_id").distinct().join(own.select("subject_id"), "subject_id", "left_anti").first()) is not None:
        raise ChannelResolutionError(f"no channel {canonical} in {lost[0]}")
    return own


def native_rate(loaded: DataFrame) -> DataFrame:
    """Per subject: the rate of the first channel that was resolved; null if there is none."""
    return loaded.groupBy("subject_id").agg(F.min_by("sf", "position").alias("sf"))


def require_safe(ids: DataFrame, column: str = "ID") -> DataFrame:
    """The rows; the first unsafe id raises."""
    bad = ids.filter(~safe_id(column)).select(column).first()
    if bad is not None:
        raise InvalidSubjectIDError(f"unsafe subject id {bad[0]!r}")
    return ids
