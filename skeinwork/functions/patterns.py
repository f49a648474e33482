"""Parts of which the patterns of several modules are made, in a form that Java, RE2 and Python read alike."""

#: The marks before a heading.
MARKS = "#{1,6}"
#: A section's number: 1, 1.2, 1.2.3 and so on.
NUMBER = r"\d+(?:\.\d+)*"
#: A line that makes the line above it a heading of a chunk.
RULE = "[=-]{2,}"
#: A line that makes the line above it a heading of a document.
UNDERLINE = "(?:=+|-+)"
#: The code fence.
TICKS = "```"
#: A row of a table.
ROW = r"^\|.+\|$"


def one_of(names) -> str:
    return "(?:" + "|".join(names) + ")"
