"""Options of a run, checked as a whole, and their command-line flags."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields

from .operators.pages import DEFAULT_FIELDS, FIELDS


@dataclass(frozen=True)
class Options:
    """What a run does. ``None`` and ``False`` switch a step off.

    Word lists are paths of list files, or "" for the default list.
    """

    path: str
    accelerated: bool = False
    thorough: bool = False
    quiet: bool = False
    verbose: bool = False
    fields: str = DEFAULT_FIELDS
    pages: str | None = None
    split: bool = False
    report: bool = False
    report_page: bool = False
    report_file: bool = False
    report_sort: bool = False
    report_limit: str = "100%"
    report_pos: bool = False
    report_only: str | None = None
    report_ignore: str | None = None
    autocorrect: bool = False
    show_raw: bool = False
    corrections: bool = False
    dictionary: str | None = None
    dictionary_large: bool = False
    dictionary_revert: bool = False
    dictionary_add: str | None = None
    dictionary_remove: str | None = None
    lemmatize: bool = False
    sentences: bool = False
    words: bool = False
    only: str | None = None
    ignore: str | None = None
    punctuation: bool = False
    numbers: bool = False
    known_words: bool = False
    lowercase: bool = False
    custom_text: str | None = None
    language: str = "eng"
    tesseract: str | None = None

    #: Options of which at most one may be set.
    EXCLUSIVE = (
        ("accelerated", "thorough"), ("quiet", "verbose"), ("report", "report_page", "report_file"),
        ("report_only", "report_ignore"), ("sentences", "words"), ("only", "ignore"),
    )

    def __post_init__(self) -> None:
        for group in self.EXCLUSIVE:
            chosen = [name for name in group if getattr(self, name) not in (None, False)]
            if len(chosen) > 1:
                raise ValueError(f"options exclude each other: {', '.join(chosen)}")
        letters = [x for x in self.fields.lower() if x in FIELDS]
        if "c" in letters and self.custom_text is None:
            raise ValueError("field c needs a custom text")

    @property
    def mode(self) -> str:
        return "thorough" if self.thorough else "accelerated" if self.accelerated else "default"

    @property
    def scope(self) -> str | None:
        return "page" if self.report_page else "file" if self.report_file else "corpus" if self.report else None


#: The flag of each option.
FLAGS = {
    "accelerated": "-a", "thorough": "-t", "quiet": "-q", "verbose": "-v", "fields": "-f", "pages": "-p", "split": "-s", "report": "-r", "report_page": "-rp", "report_file": "-rf",
    "report_sort": "-rs", "report_limit": "-rl", "report_pos": "-rpos", "report_only": "-ro", "report_ignore": "-ri", "autocorrect": "-ac", "show_raw": "-st", "corrections": "-c", "dictionary": "-d",
    "dictionary_large": "-dl", "dictionary_revert": "-dr", "dictionary_add": "-daw", "dictionary_remove": "-drw", "lemmatize": "-l", "sentences": "-ts", "words": "-tw", "only": "-po", "ignore": "-pi",
    "punctuation": "-pp", "numbers": "-pn", "known_words": "-pw", "lowercase": "-lc", "custom_text": "-ct", "language": "--language", "tesseract": "--tesseract",
}


def parse(arguments: list[str]) -> Options:
    """Options from command-line arguments."""
    parser = argparse.ArgumentParser(prog="pagemill", description="Extract, process and count the text of PDF files.", allow_abbrev=False)
    parser.add_argument("path", help="a PDF file or a folder")
    defaults = {f.name: f.default for f in fields(Options)}
    for name, flag in FLAGS.items():
        if isinstance(defaults[name], bool):
            parser.add_argument(flag, dest=name, action="store_true")
        elif name in ("only", "ignore", "report_only", "report_ignore"):
            parser.add_argument(flag, dest=name, nargs="?", const="", default=None)
        elif name == "pages":
            parser.add_argument(flag, dest=name, nargs="+")
        else:
            parser.add_argument(flag, dest=name, default=defaults[name])
    found = vars(parser.parse_args(arguments))
    found["pages"] = " ".join(found["pages"]) if found["pages"] else None
    try:
        return Options(**found)
    except ValueError as e:
        parser.error(str(e))
