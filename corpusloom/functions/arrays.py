"""Array and numeric expressions over waveforms, features, tokens and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.bind import bind
from corpusloom.operators.ordered import hash_int

PEAK_LIMIT = 0.95


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def energy(x: Column) -> Column:
    """Sum of squares in double precision."""
    return F.aggregate(
        x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")
    )


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))


def scale(x: Column, by: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double") * by)


def mono_mix(channels: Column) -> Column:
    """Mean over channels of an array of equally long channels."""
    summed = F.aggregate(
        F.slice(channels, F.lit(2), F.size(channels)),
        channels[0].cast("array<double>"),
        lambda acc, ch: F.zip_with(acc, ch, lambda a, b: a + b.cast("double")),
    )
    return bind(F.size(channels), lambda n: F.transform(summed, lambda v: v / n))


def peak_normalise(x: Column) -> Column:
    """Divide by the peak only when it is over 1."""

    def levelled(top: Column) -> Column:
        return F.when(top > 1, F.transform(x, lambda v: v.cast("double") / top))

    same = x.cast("array<double>")
    return F.coalesce(bind(peak(x), levelled), same)


def _with_gain(x: Column, gain: Column) -> Column:
    """Apply a gain, then bring the peak down to the limit if it is over it."""

    def limited(top: Column, by: Column) -> Column:
        loud = F.transform(x, lambda v: v.cast("double") * by / top * PEAK_LIMIT)
        return F.when(top > PEAK_LIMIT, loud).otherwise(scale(x, by))

    return bind(gain, lambda by: bind(peak(x) * by, lambda top: limited(top, by)))


def rms_normalise(x: Column, target: float = 0.1) -> Column:
    """Gain to a target RMS, peak limited; silent or empty arrays are returned as they are."""

    def levelled(rms: Column) -> Column:
        return F.when(rms > 0, _with_gain(x, F.lit(target) / rms))

    return F.coalesce(bind(F.sqrt(F.try_divide(energy(x), F.size(x))), levelled), x.cast("array<double>"))


def loudness_gain(x: Column, loudness: Column, target: float = -23.0) -> Column:
    """Gain to a target loudness given as a column; falls back to RMS when it is not finite."""
    gain = F.pow(F.lit(10.0), (F.lit(target) - loudness) / 20.0)
    unknown = loudness.isNull() | F.isnan(loudness) | (loudness == F.lit(float("-inf")))
    return F.when(unknown, rms_normalise(x)).otherwise(_with_gain(x, gain))


def crop_or_pad(x: Column, length: int, *key: Column | str, seed: int = 42) -> Column:
    """A window of ``length`` at an offset hashed from the key, or zeros appended."""
    n = F.size(x)
    room = F.greatest(n - length, F.lit(0))
    start = (hash_int(*key, seed=seed) % (room + 1)).cast("int")
    zero = F.lit(0).cast("float")
    padded = F.concat(x, F.array_repeat(zero, F.greatest(F.lit(length) - n, F.lit(0))))
    return F.when(n > length, F.slice(x, start + 1, F.lit(length))).otherwise(padded)


def aligned_length(frames: Column, tokens: Column, ratio: int) -> Column:
    return F.floor(F.least(frames / ratio, tokens.cast("double"))).cast("int")


def align_tokens_feats(feats: Column, tokens: Column, ratio: int) -> tuple[Column, Column]:
    n = aligned_length(F.size(feats), F.size(tokens), ratio)
    return F.slice(feats, F.lit(1), n * ratio), F.slice(tokens, F.lit(1), n)


def even_frames(samples: Column, hop: int = 480) -> Column:
    """Sample count after padding one hop when the frame count would be odd."""
    frames = F.floor((samples - hop) / hop) + 1
    return F.when(F.pmod(frames, F.lit(2)) == 1, samples + hop).otherwise(samples)


def l2_norm(x: Column) -> Column:
    return F.sqrt(energy(x))


def l2_normalise(x: Column, floor: float = 1e-12) -> Column:
    norm = F.greatest(l2_norm(x), F.lit(floor))
    return bind(norm, lambda n: F.transform(x, lambda v: v.cast("double") / n))


def pad_to(x: Column, length: Column, value) -> Column:
    return F.concat(x, F.array_repeat(F.lit(value), (length - F.size(x)).cast("int")))


def pad_mask(length: Column, longest: Column) -> Column:
    """True at padded positions."""
    positions = F.sequence(F.lit(1), longest.cast("int"))
    mask = F.transform(positions, lambda i: i > length)
    return F.when(longest > 0, mask).otherwise(F.array().cast("array<boolean>"))


def sequence_mask(length: Column, longest: Column) -> Column:
    """True at valid positions."""
    return F.transform(pad_mask(length, longest), lambda p: ~p)


def round_up_length(length: Column, downsamplings: int = 2) -> Column:
    factor = 2**downsamplings
    return (F.ceil(length / factor) * factor).cast("bigint")


def intersperse(x: Column, blank) -> Column:
    return F.concat(
        F.array(F.lit(blank)), F.flatten(F.transform(x, lambda v: F.array(v, F.lit(blank))))
    )


def standardise(x: Column, mean: Column, std: Column) -> Column:
    return F.transform(x, lambda v: (v.cast("double") - mean) / std)


def destandardise(x: Column, mean: Column, std: Column) -> Column:
    return F.transform(x, lambda v: v * std + mean)


def standardise_channels(x: Column, means: Column, stds: Column) -> Column:
    """Per-channel form for an array of channels."""
    return F.transform(x, lambda ch, i: standardise(ch, F.get(means, i), F.get(stds, i)))


def destandardise_channels(x: Column, means: Column, stds: Column) -> Column:
    return F.transform(x, lambda ch, i: destandardise(ch, F.get(means, i), F.get(stds, i)))


def expand_durations(durations: Column) -> Column:
    """Which source position owns each output frame."""
    return F.flatten(F.transform(durations, lambda n, i: F.array_repeat(i, n)))


def duration_path(durations: Column, frames: Column) -> Column:
    """Monotone 0/1 path, one row per source position, cut at ``frames`` output positions."""
    owners = F.slice(expand_durations(durations), F.lit(1), frames)

    def rows(owner: Column) -> Column:
        # a position that owns no frame is not compared with them
        none = F.array_repeat(F.lit(0), frames.cast("int"))
        row = lambda i: F.transform(owner, lambda o: (o == i).cast("int"))
        return F.transform(durations, lambda n, i: F.when((n <= 0) & owner.isNotNull(), none).otherwise(row(i)))

    return bind(pad_to(owners, frames, -1), rows)


def time_stretch(x: Column, speed: Column) -> Column:
    """Linear resampling to ``max(1, int(n / speed))`` samples (pixel centres aligned)."""
    bad = F.raise_error(F.lit("speed must be positive")).cast("int")
    wanted = F.when(speed <= 0, bad).otherwise(
        F.greatest(F.lit(1), F.floor(F.size(x) / speed).cast("int"))
    )

    def stretched(length: Column) -> Column:
        n = F.size(x)

        def at(pos: Column) -> Column:
            low = F.least(F.floor(pos).cast("int"), n - 1)
            a = F.get(x, low).cast("double")
            b = F.get(x, F.least(low + 1, n - 1)).cast("double")
            return a + (b - a) * (pos - low)

        def value(i: Column) -> Column:
            return bind(F.greatest((i + 0.5) * n / length - 0.5, F.lit(0.0)), at)

        return F.transform(F.sequence(F.lit(0), length - 1), value)

    same = x.cast("array<double>")
    return F.when((speed == 1.0) | (F.size(x) == 0), same).otherwise(bind(wanted, stretched))


def log_compress(x: Column, c: float = 1.0, clip: float = 1e-5) -> Column:
    return F.transform(x, lambda v: F.log(F.greatest(v.cast("double"), F.lit(clip)) * c))


def log_decompress(x: Column, c: float = 1.0) -> Column:
    return F.transform(x, lambda v: F.exp(v) / c)


def _powers(x: Column) -> Column:
    """Exponentials relative to the largest score."""
    return bind(
        F.array_max(x).cast("double"),
        lambda top: F.transform(x, lambda v: F.exp(v.cast("double") - top)),
    )


def softmax(x: Column) -> Column:
    def shares(powers: Column) -> Column:
        return bind(total(powers), lambda norm: F.transform(powers, lambda v: v / norm))

    return bind(_powers(x), shares)


def log_softmax(x: Column) -> Column:
    norm = F.array_max(x).cast("double") + F.log(total(_powers(x)))
    return bind(norm, lambda n: F.transform(x, lambda v: v.cast("double") - n))


def segment_seconds(start: Column, end: Column, rate: int) -> Column:
    return (end - start) / F.lit(rate)


def clip(x: Column, start: Column, end: Column) -> Column:
    """Half-open slice."""
    return F.slice(x, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def crossfade(head: Column, tail: Column, window: list[float]) -> Column:
    """Overlap-add: the first samples of ``head`` fade in while ``tail`` fades out."""
    n = len(window) // 2
    rise = F.array(*[F.lit(float(w)) for w in window[:n]])
    fall = F.array(*[F.lit(float(w)) for w in window[n:]])
    ins = F.zip_with(F.slice(head, F.lit(1), F.lit(n)), rise, lambda v, w: v.cast("double") * w)
    last = F.slice(tail, F.size(tail) - n + 1, F.lit(n))
    outs = F.zip_with(last, fall, lambda v, w: v.cast("double") * w)
    mixed = F.zip_with(ins, outs, lambda a, b: a + b)
    rest = F.slice(head, F.lit(n + 1), F.size(head)).cast("array<double>")
    return F.concat(mixed, rest)
