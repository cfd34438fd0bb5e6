"""Errors with a code and a hint."""

from __future__ import annotations

CODES = ("WORK_NOT_FOUND", "CHAPTER_NOT_FOUND", "VARIANT_NOT_FOUND", "PARAGRAPH_NOT_FOUND", "BAD_QUERY", "CORPUS_NOT_FOUND", "WIKI_NOT_BUILT", "WIKI_FILE_MISSING")


class EngineError(Exception):
    def __init__(self, code: str, message: str, hint: str = ""):
        if code not in CODES:
            raise ValueError(f"unknown error code {code}")
        super().__init__(message)
        self.code, self.message, self.hint = code, message, hint

    def payload(self) -> dict:
        return {"error": {"code": self.code, "message": self.message, "hint": self.hint}}
