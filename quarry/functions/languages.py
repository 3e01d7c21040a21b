"""Languages by file."""

from __future__ import annotations

#: The language of an extension or of a whole file name, which an index must name alike.
LANGUAGES = {
    ".as": "actionscript", ".adb": "ada", ".ads": "ada", ".agda": "agda", ".ino": "arduino", ".asm": "asm", ".s": "asm", ".astro": "astro",
    ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".bean": "beancount", ".bib": "bibtex", ".bicep": "bicep",
    ".bb": "bitbake", ".bbappend": "bitbake", ".bbclass": "bitbake", ".c": "c", ".h": "c", ".cairo": "cairo", ".capnp": "capnp",
    ".chatito": "chatito", ".clar": "clarity", ".clj": "clojure", ".cljs": "clojure", ".cljc": "clojure", ".edn": "clojure",
    ".cmake": "cmake", "CMakeLists.txt": "cmake", ".lisp": "commonlisp", ".cl": "commonlisp", ".cpon": "cpon",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".h++": "cpp", ".cs": "csharp", ".css": "css", ".csv": "csv",
    ".cu": "cuda", ".cuh": "cuda", ".d": "d", ".dart": "dart", "Dockerfile": "dockerfile", ".dtd": "dtd", ".el": "elisp",
    ".ex": "elixir", ".exs": "elixir", ".elm": "elm", ".erl": "erlang", ".hrl": "erlang", ".fnl": "fennel", ".fir": "firrtl", ".fish": "fish",
    ".f": "fortran", ".f90": "fortran", ".f95": "fortran", ".f03": "fortran", ".f08": "fortran", ".fc": "func", ".gd": "gdscript",
    ".gitattributes": "gitattributes", ".gitcommit": "gitcommit", ".gitignore": "gitignore", ".gleam": "gleam",
    ".glsl": "glsl", ".vert": "glsl", ".frag": "glsl", ".gn": "gn", ".gni": "gn", ".go": "go", "go.mod": "gomod", "go.sum": "gosum",
    ".groovy": "groovy", ".launch": "gstlaunch", ".hack": "hack", ".ha": "hare", ".hs": "haskell", ".hx": "haxe",
    ".hcl": "hcl", ".tf": "hcl", ".tfvars": "hcl", ".heex": "heex", ".hlsl": "hlsl", ".html": "html", ".htm": "html", ".hypr": "hyprlang",
    ".ispc": "ispc", ".janet": "janet", ".java": "java", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".jsdoc": "jsdoc",
    ".json": "json", ".jsonnet": "jsonnet", ".libsonnet": "jsonnet", ".jl": "julia", "Kconfig": "kconfig", ".kdl": "kdl",
    ".kt": "kotlin", ".kts": "kotlin", ".tex": "latex", ".sty": "latex", ".cls": "latex", ".ld": "linkerscript", ".ll": "llvm", ".td": "tablegen",
    ".lua": "lua", ".luadoc": "luadoc", ".luap": "luap", ".luau": "luau", ".magik": "magik", "Makefile": "make", ".mk": "make",
    ".md": "markdown", ".markdown": "markdown", ".m": "matlab", ".mat": "matlab", ".mermaid": "mermaid", "meson.build": "meson",
    ".ninja": "ninja", ".nix": "nix", ".nqc": "nqc", ".mm": "objc", ".ml": "ocaml", ".mli": "ocaml_interface", ".odin": "odin", ".org": "org",
    ".pas": "pascal", ".pp": "pascal", ".pem": "pem", ".pl": "perl", ".pm": "perl", ".pgn": "pgn", ".php": "php", ".po": "po", ".pot": "po",
    ".pony": "pony", ".ps1": "powershell", ".psm1": "powershell", ".printf": "printf", ".prisma": "prisma", ".properties": "properties",
    ".proto": "proto", ".psv": "psv", ".purs": "purescript", "MANIFEST.in": "pymanifest", ".py": "python", "qmldir": "qmldir", ".qml": "qmljs",
    ".r": "r", ".R": "r", ".rkt": "racket", ".re2c": "re2c", ".inputrc": "readline", "requirements.txt": "requirements", ".ron": "ron",
    ".rst": "rst", ".rb": "ruby", ".rs": "rust", ".scala": "scala", ".sc": "scala", ".scm": "scheme", ".ss": "scheme", ".scss": "scss",
    ".smali": "smali", ".smithy": "smithy", ".sol": "solidity", ".rq": "sparql", ".sql": "sql", ".nut": "squirrel",
    ".bzl": "starlark", "BUILD": "starlark", "WORKSPACE": "starlark", ".svelte": "svelte", ".swift": "swift", ".tcl": "tcl",
    ".thrift": "thrift", ".toml": "toml", ".tsv": "tsv", ".tsx": "typescript", ".twig": "twig", ".ts": "typescript", ".typ": "typst",
    ".rules": "udev", ".ungram": "ungrammar", ".tal": "uxntal", ".sv": "verilog", ".v": "verilog", ".vhd": "vhdl", ".vhdl": "vhdl",
    ".vim": "vim", ".vimrc": "vim", ".vue": "vue", ".wgsl": "wgsl", ".XCompose": "xcompose", ".xml": "xml", ".svg": "xml", ".xsl": "xml",
    ".yuck": "yuck", ".zig": "zig",
}
