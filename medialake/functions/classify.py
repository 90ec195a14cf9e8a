"""What kind of media a path, or the first bytes of a file, say it is."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import extension_of, stem

#: Kinds by extension.
AUDIO = ("mp3", "flac", "ogg", "oga", "opus", "m4a", "m4b", "aac", "wav", "aiff", "aif", "ape", "wv", "wma", "mka")
VIDEO = ("mp4", "m4v", "mov", "mkv", "webm", "avi")
IMAGE = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "tif", "tiff", "heic", "heif", "avif")
DOCUMENT = ("pdf", "epub", "cbz", "cbr", "txt")
KIND_OF = {e: kind for kind, es in (("audio", AUDIO), ("video", VIDEO), ("image", IMAGE), ("document", DOCUMENT)) for e in es}

#: Spellings of a format's tag.
FORMAT_OF = {"jpeg": "jpg", "tif": "tiff", "aif": "aiff"}

#: Brands of the ISO base media format.
AUDIO_BRANDS = ("M4A", "M4B", "M4P")
IMAGE_BRANDS = ("heic", "heix", "heim", "heis", "hevc", "hevm", "hevs", "mif1", "msf1", "avif", "avis")

#: First bytes in hexadecimal (a dot for any digit) and the kind they tell.
SIGNATURES = (
    ("494433", "audio"), ("FFF[1239AB]", "audio"), ("664C6143", "audio"), ("4F676753", "audio"), ("52494646........57415645", "audio"), ("464F524D........41494646", "audio"),
    ("52494646........41564920", "video"), ("FFD8", "image"), ("89504E470D0A1A0A", "image"), ("474946383[79]61", "image"), ("52494646........57454250", "image"), ("49492A00", "image"), ("4D4D002A", "image"), ("424D........00000000", "image"),
    ("25504446", "document"),
)

#: Names that folder art goes by.
ART_STEMS = ("cover", "folder", "front", "album", "poster", "fanart")
ART_EXTENSIONS = ("jpg", "jpeg", "png", "webp")
ART_MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp"}


def looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def format_tag(path: Column) -> Column:
    ext = extension_of(path)
    return F.coalesce(looked_up(ext, FORMAT_OF), ext)


def kind_by_extension(path: Column) -> Column:
    return looked_up(extension_of(path), KIND_OF)


def doc_type(header: Column) -> Column:
    """The known EBML DocType in a header: element 4282, its size in one byte, its name."""
    text = F.hex(header)
    named = lambda name: text.rlike(f"^(..){{4,}}?4282{0x80 | len(name):02X}{name.encode().hex().upper()}")
    return F.when(named("webm"), "webm").when(named("matroska"), "matroska")


def classify(path: Column, header: Column | None = None) -> Column:
    """The kind; the header's signature outvotes the extension, and says nothing if it is null or unknown."""
    said = kind_by_extension(path)
    if header is None:
        return said
    digits = F.hex(header)
    believed = F.when(said == "audio", "audio").otherwise("video")
    ebml = F.when(doc_type(header) == "webm", "video").when(doc_type(header) == "matroska", believed).otherwise(F.coalesce(said, F.lit("video")))
    brand = F.rtrim(F.decode(F.unhex(F.substring(digits, 17, 8)), "ISO-8859-1"))
    boxed = F.when(brand.isin(*AUDIO_BRANDS), "audio").when(brand.isin(*IMAGE_BRANDS), "image").otherwise(believed)
    sniffed = F.when(digits.startswith("1A45DFA3"), ebml).when((F.length(digits) >= 24) & (F.substring(digits, 9, 8) == "66747970"), boxed)
    for signature, kind in SIGNATURES:
        sniffed = sniffed.when(digits.rlike(f"^{signature}"), kind)
    return F.coalesce(sniffed, said)


def is_folder_art(path: Column) -> Column:
    return F.lower(stem(path)).isin(*ART_STEMS) & extension_of(path).isin(*ART_EXTENSIONS)


def art_mime(path: Column) -> Column:
    return F.coalesce(looked_up(extension_of(path), ART_MIME), F.lit("application/octet-stream"))


def picture_mime(data: Column) -> Column:
    """By first bytes; null if they tell nothing."""
    digits = F.hex(F.substring(data, 1, 12))
    return F.when(digits.startswith("FFD8"), "image/jpeg").when(digits.startswith("89504E47"), "image/png").when(digits.startswith("47494638"), "image/gif").when(digits.rlike("^52494646........57454250"), "image/webp").when(digits.startswith("424D"), "image/bmp")


def sidecar_kind(path: Column) -> Column:
    ext = extension_of(path)
    return F.when(ext == "lrc", "lyrics").when(ext == "srt", "subtitles").when(is_folder_art(path), "artwork")


def item_kind(path: Column, library_type: Column) -> Column:
    """The kind of a library's item; null where the file is not one: unknown kinds, and images outside image libraries."""
    kind = kind_by_extension(path)
    return F.when((kind == "image") & (library_type != "images"), F.lit(None)).otherwise(kind)
