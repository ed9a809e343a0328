"""Code tables of the graph's data model.  Fixed values, in natural order."""

from __future__ import annotations

NODE_KINDS = ["Repository", "Directory", "File", "Module", "Type", "Function", "Field", "Variable", "Constant", "Macro", "BuildTarget", "ConfigSymbol", "Owner", "Note", "Community"]
EDGE_KINDS = ["CONTAINS", "INCLUDES", "IMPORTS", "DECLARES", "DEFINES", "CALLS", "REFERENCES", "INHERITS", "IMPLEMENTS", "OVERRIDES", "TYPED_AS", "TESTS", "BUILT_FROM", "BUILD_DEPENDS", "GUARDED_BY", "OWNED_BY", "CO_CHANGED", "EXPLAINS", "MEMBER_OF"]
CONFIDENCES = ["EXTRACTED", "RESOLVED", "AMBIGUOUS"]
LANGUAGES = ["unknown", "text", "c", "c-header", "cpp", "cpp-header", "objective-c", "objective-cpp", "rust", "python", "javascript", "typescript", "java", "go", "csharp", "fsharp", "assembly", "shell", "makefile", "cmake", "gn", "kconfig", "yaml", "json", "toml", "xml", "markdown", "owners", "tsx", "fsharp-signature"]
FLAGS = ["Definition", "DeclarationOnly", "Test", "Generated", "Vendored", "Conditional", "Binary", "UndeterminedEncoding", "Skipped", "SymbolicLink", "AmbiguousEncoding", "InternalLinkage", "ExtractionTruncated"]
FLAG_MASK = 8191
ENCODINGS = ["UTF-8", "UTF-8-BOM", "UTF-16LE", "UTF-16BE", "Shift_JIS", "EUC-JP", "ISO-2022-JP", "GB18030", "Big5", "EUC-KR", "binary", "undetermined"]

#: Exact file names, then extensions in lower case (``.C`` and ``.H`` are told apart by case), to languages.
FILE_NAMES = {
    "Makefile": "makefile", "makefile": "makefile", "GNUmakefile": "makefile", "Kbuild": "makefile", "CMakeLists.txt": "cmake", "BUILD.gn": "gn", "BUILD": "gn", "Kconfig": "kconfig",
    "OWNERS": "owners", "MAINTAINERS": "owners", "CODEOWNERS": "owners",
}
EXTENSIONS = {
    "c": "c", "h": "c-header", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "c++": "cpp", "hh": "cpp-header", "hpp": "cpp-header", "hxx": "cpp-header", "inc": "cpp-header", "ipp": "cpp-header",
    "m": "objective-c", "mm": "objective-cpp", "rs": "rust", "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "tsx", "mts": "typescript", "cts": "typescript", "java": "java", "go": "go", "cs": "csharp", "fs": "fsharp", "fsi": "fsharp-signature", "fsx": "fsharp",
    "s": "assembly", "asm": "assembly", "sh": "shell", "bash": "shell", "zsh": "shell", "mk": "makefile", "cmake": "cmake", "gn": "gn", "gni": "gn", "yml": "yaml", "yaml": "yaml",
    "json": "json", "jsonc": "json", "toml": "toml", "xml": "xml", "md": "markdown", "markdown": "markdown", "txt": "text",
}
CASED_EXTENSIONS = {"C": "cpp", "H": "cpp-header"}
VENDOR_DIRECTORIES = ["third_party", "thirdparty", "vendor", "vendored", "node_modules", "external", "externals"]
TEST_DIRECTORIES = ["test", "tests", "testing", "__tests__", "spec"]
#: What marks a file's name, in lower case: its beginning or parts of it for tests, its end for generated ones.
TEST_PREFIX, TEST_PARTS = "test_", ["_test.", ".test.", "_unittest."]
GENERATED_ENDS = [".g.cs", ".generated.cs", ".pb.go", ".pb.cc", ".pb.h"]
#: Scalars each of which can be a word: ideographs, kana, bopomofo, Hangul.
CJK_RANGES = [(0x2E80, 0x2EFF), (0x3040, 0x30FF), (0x3100, 0x312F), (0x3130, 0x318F), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA960, 0xA97F), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x20000, 0x3FFFD)]


def code(table: list[str], name: str) -> int:
    """1-based code of a name; languages count from 0."""
    return table.index(name) + (0 if table is LANGUAGES else 1)
