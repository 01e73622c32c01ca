"""Columns of the tables that the operators pass to each other."""

FINDING = "lang string, ns string, path string, type string, severity string, message string, source string, translation string"
LOCK = "lang string, ns string, path string, source_hash string, translation_hash string"
VERDICT = "pair_hash string, category string, note string"
VOTE = "pair_hash string, pass int, verdict string, note string, batch bigint, calls int"
#: What begins a file of locks, what stands between two of them, and what ends it.
LOCK_FILE = ('{\n  "version": 1,\n  "locked": {\n', "\n    },\n", "\n    }\n  }\n}\n")
#: The same of a string catalog, laid out as Xcode does; ``{}`` is the source language.
CATALOG_FILE = ('{{\n  "sourceLanguage" : {},\n  "strings" : {{\n', "\n    },\n", '\n    }\n  },\n  "version" : "1.0"\n}\n')
FINDING_COLUMNS = [c.split()[0] for c in FINDING.split(", ")]

#: What each finding type says about a translation.
TYPES = {
    "missing-key": "A source key has no translation",
    "type-mismatch": "Source and translation are values of different types",
    "empty-value": "The translation of a text is blank",
    "placeholder-missing": "A placeholder of the source is lost",
    "placeholder-added": "A placeholder is not in the source",
    "plural-forms": "The number of plural forms differs",
    "glossary-violation": "A glossary term is not kept as agreed",
    "untranslated": "A text is the same as its source",
    "orphan-key": "A key does not exist in the source",
    "missing-file": "A namespace has no file in a language",
    "invalid-json": "A file is not valid JSON",
    "stale-translation": "A translation is marked for review",
    "manual-translation-clobbered": "A translation locked by hand was changed",
    "manual-translation-stale": "The source of a locked translation was changed",
    "semantic-mistranslation": "Reviewers find a different meaning",
    "semantic-omission": "Reviewers find meaning left out",
    "semantic-addition": "Reviewers find meaning added",
}
