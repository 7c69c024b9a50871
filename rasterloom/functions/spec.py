"""What a raster is and how it is encoded: types, limits, derived attributes and options.

The classes check values on the driver; the column functions derive the same attributes inside a plan, so a table of many images
needs no loop over them.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNATURE = bytes([137, 80, 78, 71, 13, 10, 26, 10])
WINDOW = 32768  # bytes that deflate looks back, and so the least chunk size


class InvalidInput(ValueError):
    """A value or call that the format or the encoder doesn't allow."""


class IncompleteImage(RuntimeError):
    """Rows that don't make up the image that its header announces."""


class ColorType(IntEnum):
    GREYSCALE = 0
    TRUECOLOR = 2
    INDEXED = 3
    GREYSCALE_ALPHA = 4
    TRUECOLOR_ALPHA = 6

    @property
    def channels(self) -> int:
        return CHANNELS[self]

    def allows(self, depth: int) -> bool:
        return depth in DEPTHS[self]


class Filter(IntEnum):
    NONE = 0
    SUB = 1
    UP = 2
    AVERAGE = 3
    PAETH = 4


class Strategy(IntEnum):
    DEFAULT = 0
    FILTERED = 1
    HUFFMAN = 2
    RLE = 3
    FIXED = 4


class Level(IntEnum):
    FAST = 1
    DEFAULT = 6
    HIGH = 9


# Fixed values of the format.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}


def parse(kind: type[IntEnum], code: int):
    try:
        return kind(code)
    except ValueError:
        raise InvalidInput(f"{code} isn't a {kind.__name__}") from None


@dataclass(frozen=True)
class RasterSpec:
    """The header. Strides round up to whole bytes for every depth."""

    width: int
    height: int
    color_type: ColorType = ColorType.TRUECOLOR
    depth: int = 8
    compression: int = 0
    filter_method: int = 0
    interlace: int = 0

    def __post_init__(self):
        object.__setattr__(self, "color_type", parse(ColorType, self.color_type))
        if not 0 < self.width < 1 << 32 or not 0 < self.height < 1 << 32:
            raise InvalidInput("width and height are from 1 to 2**32 - 1")
        if not self.color_type.allows(self.depth):
            raise InvalidInput(f"{self.color_type.name} has no depth of {self.depth}")
        if self.compression or self.filter_method:
            raise InvalidInput("compression and filter method have 0 as their only value")
        if self.interlace:
            raise InvalidInput("interlaced output isn't supported")

    @property
    def channels(self) -> int:
        return self.color_type.channels

    @property
    def bpp(self) -> int:
        """Bytes between a sample and its left neighbour."""
        return self.channels * (2 if self.depth > 8 else 1)

    @property
    def stride(self) -> int:
        return (self.channels * self.depth * self.width + 7) // 8

    def rows_per_chunk(self, chunk_size: int) -> int:
        return -(-chunk_size // (self.stride + 1))

    def chunks(self, chunk_size: int) -> int:
        return -(-self.height // self.rows_per_chunk(chunk_size))

    def halo(self) -> int:
        """Raw rows before a chunk from which its dictionary and its first row's predecessor can be rebuilt."""
        return -(-WINDOW // (self.stride + 1)) + 1


@dataclass(frozen=True)
class EncodeOptions:
    """None stands for adaptive; streaming emits a data frame for each chunk instead of one for the image."""

    chunk_size: int = 1 << 18
    level: Level = Level.DEFAULT
    strategy: Strategy | None = None
    filter: Filter | None = None
    streaming: bool = False

    def __post_init__(self):
        if self.chunk_size < WINDOW:
            raise InvalidInput(f"chunk_size is {WINDOW} at least, for a chunk is the next one's dictionary")
        object.__setattr__(self, "level", parse(Level, self.level))
        for name, kind in (("strategy", Strategy), ("filter", Filter)):
            value = getattr(self, name)
            if value is not None:
                object.__setattr__(self, name, None if value < 0 else parse(kind, value))

    def filter_for(self, spec: RasterSpec) -> Filter | None:
        """Neighbouring palette indices mean nothing, so adaptive is no filter for them."""
        if self.filter is None and spec.color_type == ColorType.INDEXED:
            return Filter.NONE
        return self.filter

    def strategy_for(self, spec: RasterSpec) -> Strategy:
        if self.strategy is not None:
            return self.strategy
        return Strategy.DEFAULT if self.filter_for(spec) == Filter.NONE else Strategy.FILTERED

    @property
    def zlib_level(self) -> int:
        return -1 if self.level == Level.DEFAULT else int(self.level)


def depth_valid(color_type: Column, depth: Column) -> Column:
    out = F.lit(False)
    for kind, depths in DEPTHS.items():
        out = F.when(color_type == kind, depth.isin(*depths)).otherwise(out)
    return out


def channels(color_type: Column) -> Column:
    out = F.lit(None).cast("long")
    for kind, n in CHANNELS.items():
        out = F.when(color_type == kind, F.lit(n).cast("long")).otherwise(out)
    return out


def bpp(color_type: Column, depth: Column) -> Column:
    return channels(color_type) * F.when(depth > 8, 2).otherwise(1)


def ceil_div(a: Column, b: Column) -> Column:
    """For whole numbers; exact, as nothing is rounded on the way."""
    return ((a + b - 1 - F.pmod(a + b - 1, b)) / b).cast("long")


def stride(color_type: Column, depth: Column, width: Column) -> Column:
    return F.shiftright(channels(color_type) * depth * width + 7, 3)


def rows_per_chunk(chunk_size: Column, stride_: Column) -> Column:
    return ceil_div(chunk_size, stride_ + 1)


def halo(stride_: Column) -> Column:
    return ceil_div(F.lit(WINDOW), stride_ + 1) + 1


def chunks_total(height: Column, rows: Column) -> Column:
    return ceil_div(height, rows)


def effective_filter(color_type: Column, filter_: Column) -> Column:
    """Null is adaptive, before and after."""
    return F.when(filter_.isNull() & (color_type == int(ColorType.INDEXED)), int(Filter.NONE)).otherwise(filter_)


def effective_strategy(color_type: Column, filter_: Column, strategy: Column) -> Column:
    plain = F.coalesce(effective_filter(color_type, filter_) == int(Filter.NONE), F.lit(False))
    return F.coalesce(strategy, F.when(plain, int(Strategy.DEFAULT)).otherwise(int(Strategy.FILTERED)))


def palette_accepted(palette_bytes: Column, after_transparency: Column) -> Column:
    """Whether a palette of so many bytes may be written."""
    return (palette_bytes >= 3) & (palette_bytes % 3 == 0) & ~after_transparency


def transparency_accepted(color_type: Column, length: Column, palette_bytes: Column) -> Column:
    """Whether transparency of so many bytes may be written; palette_bytes is null without a palette."""
    return (
        F.when(color_type == int(ColorType.GREYSCALE), length == 2)
        .when(color_type == int(ColorType.TRUECOLOR), length == 6)
        .when(color_type == int(ColorType.INDEXED), F.coalesce((length > 0) & (length * 3 <= palette_bytes), F.lit(False)))
        .otherwise(False)
    )


def side_problem(color_type: Column, side: Column) -> Column:
    """What is wrong with an image's side data, or null. side: array of (position, tag, data) in order."""
    named = lambda tag: F.filter(side, lambda s: s["tag"] == tag)
    place = lambda tag: F.array_position(F.transform(side, lambda s: s["tag"]), tag)
    palette = F.octet_length(F.get(named("PLTE"), F.lit(0))["data"])
    return (
        F.when(F.exists(side, lambda s: F.octet_length(s["tag"].cast("binary")) != 4), "a tag has four bytes")
        .when(F.size(named("PLTE")) > 1, "an image has one palette")
        .when(F.coalesce(~palette_accepted(palette, F.lit(False)), F.lit(False)), "a palette holds whole entries of three bytes")
        .when((place("tRNS") > 0) & (place("tRNS") < place("PLTE")), "a palette comes before transparency")
        .when((color_type == int(ColorType.INDEXED)) & (F.size(named("PLTE")) == 0), "indexed rows need a palette")
        .when(F.exists(named("tRNS"), lambda s: ~transparency_accepted(color_type, F.octet_length(s["data"]), palette)), "transparency doesn't fit the color type or palette")
    )


def header_problem(width: Column, height: Column, depth: Column, color_type: Column) -> Column:
    """What is wrong with a header, or null."""
    most = (1 << 32) - 1
    fits = lambda x: F.coalesce(x.between(1, most), F.lit(False))
    return F.when(~fits(width) | ~fits(height), "width and height are from 1 to 2**32 - 1").when(~F.coalesce(depth_valid(color_type, depth), F.lit(False)), "the color type hasn't this depth")
