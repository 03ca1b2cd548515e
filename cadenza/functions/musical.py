"""Musical labels as native columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Upper bpm bound (exclusive) and name of each tempo class.
TEMPO_CLASSES = [(60, "Largo"), (76, "Adagio"), (108, "Andante"), (120, "Moderato"), (156, "Allegro"), (176, "Vivace")]
# Lower bpm bound (exclusive) and wording of each semantic label.
SEMANTIC_TEMPO = [(170, "High Intensity"), (140, "Energetic"), (115, "Driving"), (85, "Steady")]


def tempo_class(bpm: Column) -> Column:
    out = None
    for bound, name in TEMPO_CLASSES:
        test = bpm < bound
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.when(bpm.isNotNull(), out.otherwise("Presto"))


def semantic_tempo(bpm: Column) -> Column:
    out = None
    for bound, name in SEMANTIC_TEMPO:
        test = bpm > bound
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.when(bpm.isNotNull(), out.otherwise("Relaxed"))


def fast_enough(bpm: Column, confidence: Column, min_bpm: float = 140.0, min_confidence: float = 0.5) -> Column:
    """Whether a song suits a high-intensity workout."""
    return F.coalesce((bpm >= min_bpm) & (confidence >= min_confidence), F.lit(False))


def mood(valence: Column, energy: Column, cut: float = 0.5) -> Column:
    """The quadrant of the valence-energy plane."""
    return (
        F.when((valence >= cut) & (energy >= cut), "happy")
        .when(valence >= cut, "calm")
        .when(energy >= cut, "angry")
        .when(valence.isNotNull() & energy.isNotNull(), "sad")
    )
