"""What pages show: sizes, times, durations; and frames, boxes and rotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DENSE_SECONDS, SPARSE_STEP, MOST_FRAMES, POSTER_SECOND = 60, 10, 600, 1.0
CROP_MARGIN = 0.4


def human_bytes(n: Column) -> Column:
    """Bytes in the largest unit that leaves one or more, one decimal from KB on.

    The decimal is rounded in whole numbers, halves to the even one, as C and Python do; Java's formatter rounds them up.
    """
    whole = n.cast("bigint")
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    shown = F.format_string("%d B", whole)
    for i in range(1, len(units)):
        # Tenths of the unit, and what is left of them in tenths of a byte.
        over = F.shiftright(whole, 10 * i)
        rest = whole.bitwiseAND(F.lit(1024**i - 1)) * 10
        tenths, left = over * 10 + F.shiftright(rest, 10 * i), rest.bitwiseAND(F.lit(1024**i - 1))
        half = 1024**i // 2
        tenths += F.when((left > half) | ((left == half) & (tenths % 2 == 1)), 1).otherwise(0)
        shown = F.when(n >= 1024**i, F.format_string(f"%d.%d {units[i]}", F.floor(tenths / 10), tenths % 10)).otherwise(shown)
    return shown


def local_minute(epoch: Column) -> Column:
    """Years of five digits and more have no sign."""
    return F.ltrim(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm"), F.lit("+"))


def clock(seconds: Column) -> Column:
    """m:ss."""
    s = F.floor(seconds).cast("bigint")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def frame_schedule(duration: Column) -> Column:
    """Seconds at which a video is sampled: each of the first minute, then every tenth; long ones thinned to 600 frames."""
    # In closed form: how many times there are, which of them stay, and the second of each.
    dense = F.least(F.ceil(duration), F.lit(DENSE_SECONDS)).cast("int")
    n = dense + F.greatest(F.ceil((duration - DENSE_SECONDS) / SPARSE_STEP), F.lit(0)).cast("int")
    half = MOST_FRAMES // 2
    step = F.greatest(F.lit(1), F.floor((n - half) / half)).cast("int")
    many = n > MOST_FRAMES
    kept = F.when(many, half + F.least(F.lit(MOST_FRAMES - half), F.ceil((n - half) / step))).otherwise(n).cast("int")

    def second(k: Column) -> Column:
        i = F.when(many & (k >= half), (k - half) * step + half).otherwise(k)
        return F.when(i < DENSE_SECONDS, i).otherwise((i - DENSE_SECONDS) * SPARSE_STEP + DENSE_SECONDS).cast("double")

    return F.when(duration.isNull() | (duration <= 0), F.array(F.lit(POSTER_SECOND))).otherwise(F.transform(F.sequence(F.lit(0), kept - 1), second))


def turned(rotation: Column, delta: Column | int) -> Column:
    """Degrees 0 to 359, also for turns to the left."""
    return F.pmod(rotation + delta, F.lit(360)).cast("int")


def class_degrees(k: Column) -> Column:
    return F.pmod(k * 90, F.lit(360)).cast("int")


def best_class(logits: Column) -> Column:
    """The class with the largest logit and its probability by softmax."""
    most = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x - most)), F.lit(0.0), lambda a, x: a + x)
    k = (F.array_position(logits, most) - 1).cast("int")
    return F.struct(k.alias("class"), class_degrees(k).alias("degrees"), (F.lit(1.0) / total).alias("prob"))


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def top_left(kind: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Detections give a box's centre, faces its corner; both as a corner."""
    centred = kind == "det"
    return box(F.when(centred, x - w / 2).otherwise(x), F.when(centred, y - h / 2).otherwise(y), w, h)


def turn_box(degrees: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """A normalised box, its picture turned clockwise."""
    d = F.pmod(degrees, F.lit(360))
    return (
        F.when(d == 90, box(F.lit(1.0) - (y + h), x, h, w))
        .when(d == 180, box(F.lit(1.0) - (x + w), F.lit(1.0) - (y + h), w, h))
        .when(d == 270, box(y, F.lit(1.0) - (x + w), h, w))
        .otherwise(box(x, y, w, h))
    )


def normalised(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, centred: bool = False) -> Column:
    """A box in pixels as fractions of the picture: its corner, or its centre."""
    w, h = (x2 - x1) / width, (y2 - y1) / height
    x, y = x1 / width, y1 / height
    return box(x + w / 2, y + h / 2, w, h) if centred else box(x, y, w, h)


def crop_rect(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, margin: float = CROP_MARGIN) -> Column:
    """Pixels of a face's box with a margin, inside the picture."""
    px, py = w * width * margin, h * height * margin
    left, top = F.greatest(F.lit(0), (x * width - px).cast("int")), F.greatest(F.lit(0), (y * height - py).cast("int"))
    right, bottom = F.least(width, ((x + w) * width + px).cast("int")), F.least(height, ((y + h) * height + py).cast("int"))
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


def downscaled(width: Column, height: Column, most: int = 4096 * 4096) -> Column:
    """Width and height with at most so many pixels."""
    scale = F.least(F.lit(1.0), F.sqrt(F.lit(float(most)) / (width.cast("double") * height)))
    return F.struct((width * scale).cast("int").alias("width"), (height * scale).cast("int").alias("height"))
