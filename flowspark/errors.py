"""Errors with stable codes."""

from __future__ import annotations


class FlowError(Exception):
    code = "ERROR"


class ParseError(FlowError):
    code = "SYNTAX_ERROR"

    def __init__(self, message: str, at: int = 0):
        super().__init__(message)
        self.at = at


class CompileError(FlowError):
    code = "INVALID_EXPRESSION"


class UnknownFunction(CompileError):
    code = "FUNCTION_NOT_FOUND"


class StreamNotFound(FlowError):
    code = "STREAM_NOT_FOUND"


class StreamExists(FlowError):
    code = "STREAM_ALREADY_EXISTS"


class FlowNotFound(FlowError):
    code = "FLOW_NOT_FOUND"


class FlowExists(FlowError):
    code = "FLOW_ALREADY_EXISTS"


class FlowCycle(FlowError):
    code = "FLOW_CYCLE"


class LookupNotFound(FlowError):
    code = "LOOKUP_NOT_FOUND"


class LookupExists(FlowError):
    code = "LOOKUP_ALREADY_EXISTS"


class InvalidLookup(FlowError):
    code = "INVALID_LOOKUP"


class ExpectationFailed(FlowError):
    code = "EXPECTATION_FAILED"


class SubscriptionNotFound(FlowError):
    code = "SUBSCRIPTION_NOT_FOUND"
