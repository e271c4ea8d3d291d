"""Stems and notes: gates, velocity balance, programs, channels, shapes and class scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, half_up

# fixed values: default program and drum flag by label; other labels have program 0
LABEL_DEFAULTS = {"drums": (0, True), "bass": (33, False), "vocals": (85, False), "guitar": (25, False), "piano": (0, False), "other": (0, False)}

# fixed values: class -> program in the order that settles ties (-1: drum kit)
CLASS_PROGRAMS = [
    (24, 85), (25, 52), (26, 85), (27, 52), (28, 52), (29, 85), (30, 54), (134, 25), (135, 25), (136, 27), (137, 33), (138, 25), (139, 25),
    (140, 27), (141, 25), (142, 105), (143, 104), (144, 105), (145, 107), (146, 24), (147, 0), (148, 0), (149, 4), (150, 16), (151, 16), (152, 16),
    (153, 81), (155, 6), (157, -1), (158, -1), (159, -1), (160, -1), (161, -1), (162, -1), (163, -1), (166, -1), (167, -1), (169, -1), (170, -1),
    (171, -1), (164, 47), (168, 115), (173, 14), (174, 11), (175, 12), (176, 9), (177, 11), (178, 114), (179, 48), (180, 61), (181, 60), (182, 56),
    (183, 57), (184, 40), (185, 48), (186, 40), (187, 45), (188, 42), (189, 32), (190, 73), (191, 73), (192, 65), (193, 71), (194, 46), (195, 14),
    (196, 14), (197, 112), (200, 14), (201, 112), (202, 14), (203, 22), (204, 21), (205, 109), (206, 58), (207, 60), (208, 85),
]
GENERIC_SYNTH_CLASS = 153

# fixed values: the names of programs 0 to 127, eight of a family in a line
PROGRAM_NAMES = (
    "Acoustic Grand Piano", "Bright Acoustic Piano", "Electric Grand Piano", "Honky-tonk Piano", "Electric Piano 1", "Electric Piano 2", "Harpsichord", "Clavinet",
    "Celesta", "Glockenspiel", "Music Box", "Vibraphone", "Marimba", "Xylophone", "Tubular Bells", "Dulcimer",
    "Drawbar Organ", "Percussive Organ", "Rock Organ", "Church Organ", "Reed Organ", "Accordion", "Harmonica", "Tango Accordion",
    "Acoustic Guitar (nylon)", "Acoustic Guitar (steel)", "Electric Guitar (jazz)", "Electric Guitar (clean)", "Electric Guitar (muted)", "Overdriven Guitar", "Distortion Guitar", "Guitar Harmonics",
    "Acoustic Bass", "Electric Bass (finger)", "Electric Bass (pick)", "Fretless Bass", "Slap Bass 1", "Slap Bass 2", "Synth Bass 1", "Synth Bass 2",
    "Violin", "Viola", "Cello", "Contrabass", "Tremolo Strings", "Pizzicato Strings", "Orchestral Harp", "Timpani",
    "String Ensemble 1", "String Ensemble 2", "Synth Strings 1", "Synth Strings 2", "Choir Aahs", "Voice Oohs", "Synth Voice", "Orchestra Hit",
    "Trumpet", "Trombone", "Tuba", "Muted Trumpet", "French Horn", "Brass Section", "Synth Brass 1", "Synth Brass 2",
    "Soprano Sax", "Alto Sax", "Tenor Sax", "Baritone Sax", "Oboe", "English Horn", "Bassoon", "Clarinet",
    "Piccolo", "Flute", "Recorder", "Pan Flute", "Blown Bottle", "Shakuhachi", "Whistle", "Ocarina",
    "Lead 1 (square)", "Lead 2 (sawtooth)", "Lead 3 (calliope)", "Lead 4 (chiff)", "Lead 5 (charang)", "Lead 6 (voice)", "Lead 7 (fifths)", "Lead 8 (bass + lead)",
    "Pad 1 (new age)", "Pad 2 (warm)", "Pad 3 (polysynth)", "Pad 4 (choir)", "Pad 5 (bowed)", "Pad 6 (metallic)", "Pad 7 (halo)", "Pad 8 (sweep)",
    "FX 1 (rain)", "FX 2 (soundtrack)", "FX 3 (crystal)", "FX 4 (atmosphere)", "FX 5 (brightness)", "FX 6 (goblins)", "FX 7 (echoes)", "FX 8 (sci-fi)",
    "Sitar", "Banjo", "Shamisen", "Koto", "Kalimba", "Bag pipe", "Fiddle", "Shanai",
    "Tinkle Bell", "Agogo", "Steel Drums", "Woodblock", "Taiko Drum", "Melodic Tom", "Synth Drum", "Reverse Cymbal",
    "Guitar Fret Noise", "Breath Noise", "Seashore", "Bird Tweet", "Telephone Ring", "Helicopter", "Applause", "Gunshot",
)
UNKNOWN_PROGRAM = "Unknown"



def loudness(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Root mean square and peak of each group; 0 where all values are null."""
    return df.groupBy(*keys).agg(F.coalesce(F.sqrt(F.avg(F.col(value) * F.col(value))), F.lit(0.0)).alias("rms"), F.coalesce(F.max(F.abs(F.col(value))), F.lit(0.0)).alias("peak"))


def _loudest(track: Sequence[str]) -> Column:
    return F.max("rms").over(Window.partitionBy(*track))


def silent(stems: DataFrame, track: Sequence[str], ratio: float = 0.04) -> DataFrame:
    """stems with `silent`: quieter than `ratio` of the track's loudest; none in a silent track."""
    return stems.withColumn("silent", F.coalesce((F.col("rms") < ratio * _loudest(track)) & (_loudest(track) > 0), F.lit(False)))


def velocity_scales(stems: DataFrame, track: Sequence[str], least: float = 0.35) -> DataFrame:
    """stems with `scale`: the share of the loudest, kept within `least` and 1; silent tracks have no rows."""
    return stems.withColumn("_top", _loudest(track)).filter("_top > 0").withColumn("scale", clip(F.col("rms") / F.col("_top"), least, 1.0)).drop("_top")


def balanced(notes: DataFrame, scales: DataFrame, keys: Sequence[str], velocity: str = "velocity") -> DataFrame:
    """Notes with scaled velocities in 1 to 127; notes of stems without a scale stay as they are."""
    joined = notes.join(scales.select(*keys, "scale"), list(keys), "left")
    new = half_up(F.col(velocity) * F.col("scale"))
    return joined.withColumn(velocity, F.when(F.col("scale").isNull(), F.col(velocity)).otherwise(F.greatest(F.lit(1), F.least(F.lit(127), new))).cast("long")).drop("scale")


def defaults(stems: DataFrame, label: str = "label") -> DataFrame:
    """stems with the default program and drum flag of their label."""
    table = F.create_map(*[x for k, (p, d) in LABEL_DEFAULTS.items() for x in (F.lit(k), F.struct(F.lit(p).alias("program"), F.lit(d).alias("drum")))])
    own = table[F.col(label)]
    return stems.withColumn("program", F.coalesce(own["program"], F.lit(0))).withColumn("drum", F.coalesce(own["drum"], F.lit(False)))


def overridden(stems: DataFrame, programs: DataFrame, label: str | Sequence[str] = "label") -> DataFrame:
    """stems whose program is replaced where `programs` (label, override) has one; `label` may be several columns."""
    return stems.join(programs, label if isinstance(label, str) else list(label), "left").withColumn("program", F.coalesce("override", "program")).drop("override")


def named(stems: DataFrame, program: str = "program") -> DataFrame:
    """stems with `program_name`; numbers without a name are Unknown."""
    names = F.array(*map(F.lit, PROGRAM_NAMES))
    known = F.col(program).between(0, len(PROGRAM_NAMES) - 1)
    return stems.withColumn("program_name", F.when(known, F.get(names, F.col(program).cast("int"))).otherwise(UNKNOWN_PROGRAM))


def zipped(df: DataFrame, keys: Sequence[str], labels: str, programs: str) -> DataFrame:
    """(keys, label, override) from a list of labels and one of programs, by place: the shorter ends both, and the last of equal labels holds."""
    n = F.least(F.size(labels), F.size(programs))
    pairs = df.filter(n > 0).select(*keys, F.posexplode(F.arrays_zip(F.slice(labels, F.lit(1), n).alias("label"), F.slice(programs, F.lit(1), n).alias("override"))).alias("_k", "_p"))
    return pairs.groupBy(*keys, F.col("_p.label").alias("label")).agg(F.max_by("_p.override", "_k").alias("override"))


def with_label(labels: Column, label: Column) -> Column:
    """A set of labels and one more."""
    return F.array_union(labels, F.array(label))


def without_label(labels: Column, label: Column) -> Column:
    """A set of labels without one."""
    return F.array_except(labels, F.array(label))


def channels(stems: DataFrame, track: Sequence[str], order: str, drum: Column) -> DataFrame:
    """stems with `channel`: drums on 9, others in order over 0 to 15 without 9, again from 0 after fifteen."""
    split = stems.withColumn("_drum", drum)
    k = (F.row_number().over(Window.partitionBy(*track, "_drum").orderBy(order)) - 1) % 15
    return split.withColumn("channel", F.when(F.col("_drum"), 9).otherwise(k + (k >= 9).cast("int")).cast("long")).drop("_drum")


def note_shapes(notes: DataFrame, keys: Sequence[str], start: str, end: str, pitch: str, seq: str, joined: float = 0.05) -> DataFrame:
    """Of each group: n, median_pitch, mean_duration, legato (share of gaps to the next note of at most `joined`)."""
    gap = F.lead(start).over(Window.partitionBy(*keys).orderBy(start, seq)) - F.col(end)
    rows = notes.withColumn("_gap", gap).withColumn("_long", F.col(end) - F.col(start))
    n = F.count("*")
    return rows.groupBy(*keys).agg(n.alias("n"), F.median(pitch).alias("median_pitch"), F.avg("_long").alias("mean_duration"), F.when(n > 1, F.count_if(F.col("_gap") <= joined) / (n - 1)).otherwise(0.0).alias("legato"))


def roles(shapes: DataFrame, low_pitch: float = 48, pad: float = 0.6, short: float = 0.25, plucked: float = 0.3) -> DataFrame:
    """shapes with `role` and `program`; fewer than four notes have neither."""
    c = F.col
    role = F.when(c("n") < 4, None).when(c("median_pitch") <= low_pitch, "BASS").when(c("legato") >= pad, "SUSTAINED_PAD").when((c("mean_duration") <= short) & (c("legato") <= plucked), "RHYTHMIC_PLUCK").otherwise("LEAD")
    program = F.create_map(*[F.lit(x) for pair in (("BASS", 38), ("SUSTAINED_PAD", 89), ("RHYTHMIC_PLUCK", 80), ("LEAD", 81)) for x in pair])
    return shapes.withColumn("role", role).withColumn("program", program[c("role")])


def best_class(scores: DataFrame, keys: Sequence[str], cls: str, score: str, least, order: str) -> DataFrame:
    """The best scoring class of each group that reaches `least`; the later by `order` wins a tie."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.desc(order))
    return scores.filter(F.col(score) >= least).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def instruments(stems: DataFrame) -> DataFrame:
    """stems (label, audio_empty, class, score, role_program) with program, drum and confidence, by the first rule that fits.

    Drums and empty audio take the label's default; a class that isn't the generic synth takes its
    own program and score; other labels than vocals take that of the notes' shape; the rest the default.
    """
    table = F.create_map(*[F.lit(x) for pair in CLASS_PROGRAMS for x in pair])
    base = defaults(stems.drop("program", "drum")).withColumn("_class", table[F.col("class")])
    plain = (F.col("label") == "drums") | F.col("audio_empty")
    tagged = ~plain & F.col("_class").isNotNull() & (F.col("class") != GENERIC_SYNTH_CLASS)
    shaped = ~plain & ~tagged & (F.col("label") != "vocals") & F.col("role_program").isNotNull()
    program = F.when(tagged, F.greatest(F.col("_class"), F.lit(0))).when(shaped, F.col("role_program")).otherwise(F.col("program"))
    drum = F.when(tagged, F.col("_class") == -1).when(shaped, False).otherwise(F.col("drum"))
    return base.withColumn("program", program).withColumn("drum", drum).withColumn("confidence", F.when(tagged, F.col("score"))).drop("_class")
