"""Word sets, in alphabetical order. They are constants of the interface, like the names of its columns: what keywords, references and headings are depends on them."""

from __future__ import annotations

#: Words that aren't content.
STOPWORDS = (
    "a about abstract after al all also an and any appendix are article articles articulo articulos artículo artículos as at been before but by can clause "
    "clauses com commission con consejo contents copyright could council de del des directive directives document documents dos ebook ebooks esta estas "
    "este estos europea european europeas europeo europeos figure for foundation from guide gutenberg had has have her him his how html index into "
    "introduction its las less ley leyes license like los markdown may might more new not notes notice our overview para parlamento parliament per por "
    "present presente presentes project que reglamento reglamentos regulation regulations section should table text than that the their them then they this "
    "txt una unas union unión uno unos use used using via was were what when where who why will with would you your"
).split()
#: Terms of boilerplate; a text with four of them says little.
LOW_SIGNAL = (
    "archive copyright donate donations ebook ebooks foundation gutenberg license project trademark"
).split()
#: Keywords too general to relate two documents.
GENERIC_ANCHORS = (
    "abstract appendix chapter contents figure html index introduction markdown notice overview pdf section table text txt version"
).split()
#: Words of two letters that may be searched for.
SHORT_TOKENS = (
    "ai api db eu id ml sdk ui uk us ux"
).split()
#: Extensions, which aren't searched for.
NOISE_TOKENS = (
    "doc docx html jpeg jpg json md pdf png txt"
).split()
#: Words that are no symbols.
GENERIC_SYMBOLS = (
    "a all and any appendix ascii before chapter chorus copyright distribute e.g ebook etc first full gutenberg i.e king license prince project queen "
    "second start the u.s war"
).split()
#: Words of notices, which titles don't hold.
LEGAL_WORDS = (
    "attribution copyright grants journalistic license permission provided reproduce reserved rights scholarly solely"
).split()
#: Extensions of paths, as patterns.
PATH_SUFFIXES = "cfg csv docx html? ini ipynb js json jsx markdown md pdf py sql toml ts tsx txt ya?ml".split()
#: Names of sections in numbered documents, as patterns.
SECTION_NAMES = ["Abstract", "Acknowledge?ments?", "Appendix(?:es)?", "Background", "Conclusions?", "Copyright Notice", "Introduction", "References", "Status of This Memo"]
#: Names of sections that begin a chunk, as patterns.
CHUNK_SECTION_NAMES = ["Abstract", "Acknowledge?ments?", r"Appendix(?:\s+[A-Z0-9]+)?", "Background", "Conclusions?", "Contents", "Copyright Notice", "Foreword", "Introduction", "Preface", "References", "Status of This Memo", "Table of Contents"]
#: Divisions of books and plays.
DIVISIONS = ["Act", "Appendix", "Book", "Chapter", "Part", "Scene"]
#: Tags, roles and classes of parts of pages that aren't content.
PAGE_TAGS = {"footer", "header", "nav", "noscript", "script", "style"}
PAGE_ROLES = {"banner", "contentinfo", "navigation", "search"}
PAGE_CLASSES = ["breadcrumb", "breadcrumbs", "headerlink", "permalink", "sidebar"]
