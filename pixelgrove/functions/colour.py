"""What a request makes of a picture's colour space, and requests that contradict themselves, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each space is called.
LABELS = {"untagged": "untagged (assumed sRGB)", "srgb": "sRGB", "display_p3": "Display-P3", "other": "unrecognised colour space"}
# What a format says about quality and size ceilings.
QUALITY_NOTES = {
    "jpeg": "JPEG has a quality setting, so the slider does something here. 60 is a good default for a photo, 90 and above for a screenshot.",
    "png": "PNG is stored exactly as it is drawn, so it has no quality setting: the file will be as large as the picture needs, whatever the slider says. Ask for JPEG or WebP if you need it smaller.",
    "webp": "WebP has a quality setting, and at a given quality it is smaller than JPEG for most photographs — 60 is a good default for a photo, and a byte ceiling works here too.",
    "gif": "GIF is palette-quantised, so it has no quality setting and a size ceiling cannot be applied to it. It is the right choice for an animation, not for a photograph. Ask for JPEG or WebP if you need the file to fit under a limit.",
    "tiff": "TIFF is stored without lossy compression, so it has no quality setting and a size ceiling cannot be applied to it. Use it for editing or printing; ask for JPEG or WebP if you need the file to fit under a limit.",
    "bmp": "BMP is an uncompressed bitmap with no quality setting, so a size ceiling cannot be applied to it. It is here because some tools only read it, not because it saves space. Ask for JPEG or WebP if you need a smaller file.",
    "ico": "ICO is uncompressed and has no quality setting, so a size ceiling cannot be applied to it. Ask for JPEG or WebP if you need a size limit; keep PNG for anything that is not a Windows icon.",
    "avif": "AVIF has a quality setting, and it is the smallest of the formats here at a given quality — at the cost of an encode that takes seconds, not milliseconds.",
    "heic": "HEIC and HEIF are read-only here: this build opens your iPhone photo and converts it, but never writes one. Ask for JPEG, PNG or WebP as the output format.",
    "heif": "HEIC and HEIF are read-only here: this build opens your iPhone photo and converts it, but never writes one. Ask for JPEG, PNG or WebP as the output format.",
}
# What a format says that cannot carry a profile.
ICC_NOTES = {
    "webp": "this build cannot write a colour profile into WebP, so the photo's colours would be attached to nothing. Ask for JPEG or PNG to keep the profile, or turn the option off to convert the photo to sRGB instead",
    "": "this format cannot carry a colour profile. Ask for JPEG or PNG to keep it, or turn the option off to convert the photo to sRGB instead",
}
# What is said of a colour space that cannot be converted, by what the profile declares; and of contradicting options.
UNSUPPORTED = {
    "CMYK": "this photo is CMYK, and this build cannot convert CMYK",
    "grayscale": "this photo is tagged as grayscale, which this build cannot convert",
    "RGB": ("this photo is tagged with an RGB colour space that is neither sRGB nor Display-P3 — Adobe RGB or ProPhoto, most likely — and this build cannot convert it to ", ""),
    "other": ("this photo's colour profile says it is ", ""),
    "": "this photo's colour profile is in a space this build cannot name",
}
UNSUPPORTED_REST = (" to ", " without an ICC colour-management engine. Re-save the photo as sRGB or Display-P3 — any photo app or print shop will do that — or turn on 'keep the original colour values' to export the pixels unchanged, which means they will look wrong on a screen that is not the source's colour space (", " was the file's colour space)")
CONFLICT = "'keep the original colour values' and 'carry the colour profile' ask for opposite outputs: one leaves the file untagged, the other writes a profile into it. Pick one — leaving both off converts the photo to sRGB, which is what most exports want"
# The sentence of a refused animation, around its number of frames.
REFUSED_ANIMATION = ("This file is an animation of ", " frames, and the format you chose holds one picture, so nothing was written rather than quietly dropping the rest. Choose GIF output to keep every frame, or ask for the first frame only if that is what you want.")


def _looked_up(key: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def label(space: Column) -> Column:
    return _looked_up(space, LABELS)


def working(space: Column) -> Column:
    """What pixels are taken for: a file that says nothing is sRGB."""
    return F.when(space == "untagged", "srgb").otherwise(space)


def convertible(source: Column, target: Column) -> Column:
    """Whether there is a matrix between two spaces."""
    known = [working(c).isin("srgb", "display_p3") for c in (source, target)]
    return known[0] & known[1]


def colour_error(source: Column, target: Column, keep: Column, embed: Column, supports_icc: Column, icc_present: Column) -> Column:
    """conflicting_options, colour_profile, unsupported_colour_space or null; the first that holds."""
    carried = F.when(~supports_icc | ~icc_present, "colour_profile")
    return F.when(keep & embed, "conflicting_options").otherwise(F.when(keep, None).when(embed, carried).when(~convertible(source, target), "unsupported_colour_space"))


def output_space(source: Column, target: Column, keep: Column, embed: Column) -> Column:
    return F.when(keep | embed, source).otherwise(target)


def moves_pixels(source: Column, target: Column, keep: Column, embed: Column) -> Column:
    """Whether pixels change; an untagged picture's never do on the way to sRGB."""
    return ~keep & ~embed & (working(source) != working(target))


def quality_note(fmt: Column) -> Column:
    return _looked_up(fmt, QUALITY_NOTES)


def icc_note(fmt: Column) -> Column:
    return F.when(fmt == "webp", ICC_NOTES["webp"]).otherwise(ICC_NOTES[""])


def settings_error(lossless: Column, target_bytes: Column) -> Column:
    """no_quality_setting where a byte ceiling is asked of a format without quality, else null."""
    return F.when(target_bytes.isNotNull() & lossless, "no_quality_setting")


def email_ceiling(target_bytes: Column) -> Column:
    """What a mail relay takes: 2 MiB at most; its search goes down to quality 25."""
    return F.least(target_bytes, F.lit(2 << 20).cast("long"))


def refusal_note(frames: Column) -> Column:
    return F.concat(F.lit(REFUSED_ANIMATION[0]), frames.cast("string"), F.lit(REFUSED_ANIMATION[1]))


def conflict_note(keep: Column, embed: Column) -> Column:
    """What is said where both options are on; else null."""
    return F.when(keep & embed, CONFLICT)


def unsupported_note(source: Column, target: Column, declared: Column) -> Column:
    """What is said of a colour space without a matrix; ``declared`` is what the profile says it is, null if nothing that has a name."""
    to, (a, b, c) = label(target), map(F.lit, UNSUPPORTED_REST)
    space = (
        F.when(declared.isNull(), UNSUPPORTED[""]).when(declared == "CMYK", UNSUPPORTED["CMYK"]).when(declared == "grayscale", UNSUPPORTED["grayscale"])
        .when(declared == "RGB", F.concat(F.lit(UNSUPPORTED["RGB"][0]), to)).otherwise(F.concat(F.lit(UNSUPPORTED["other"][0]), declared))
    )
    return F.concat(space, a, to, b, label(source), c)
