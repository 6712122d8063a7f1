"""The whole analysis of a table of documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.functions.text import normalize
from pactlens.operators import findings as fo
from pactlens.operators import segment, structure, windows
from pactlens.operators.merging import annotated, merge_findings


@dataclass(frozen=True)
class Analysis:
    paragraphs: DataFrame
    windows: DataFrame
    findings: DataFrame
    summary: DataFrame

    def annotated(self) -> DataFrame:
        """What a reader of the document is shown: see merging.annotated()."""
        return annotated(self.paragraphs, self.findings)


def analyze(docs: DataFrame, cues: tuple[fo.Cue, ...] = fo.CUES, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Analysis:
    """Paragraphs, windows, merged findings and a summary for each document (doc_id, text), all lazy.

    The cue classifier reads each paragraph once, so overlapping windows do not multiply its findings; windows are what a remote
    classifier would be given. `keep` is given the paragraphs and the findings, which several results are made of: it may persist,
    checkpoint or write them and gives what is read on from.
    """
    merged = segment.merge_continuations(segment.paragraphs_of(docs))
    clean = merged.withColumn("text", normalize(F.col("text")))
    pathed = structure.section_paths(structure.with_headings(clean))
    parted = keep(structure.sections(structure.drop_garbage(pathed)))
    bodies = windows.body(parted)
    found = fo.classify(bodies.select("doc_id", "idx", "text"), cues)
    # merging is no fixpoint: what the second time merges depends on the quotes that the first has chosen, so results are merged twice
    findings = keep(merge_findings(fo.grade(found), times=2))
    return Analysis(parted, windows.plan_windows(bodies), findings, fo.summarize(findings, docs))
