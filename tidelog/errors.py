"""Errors of the log engine."""

from __future__ import annotations


class LogError(Exception):
    """Any error that the engine itself raises."""


class OffsetOutOfRange(LogError):
    def __init__(self, offset: int, start: int, end: int):
        super().__init__(f"offset {offset} is not within {start}..{end}")
        self.offset, self.start, self.end = offset, start, end


class OffsetEvicted(LogError):
    def __init__(self, offset: int, next_available: int):
        super().__init__(f"offset {offset} was evicted; the next available one is {next_available}")
        self.offset, self.next_available = offset, next_available


class RecordTooLarge(LogError):
    pass


class PartitionFull(LogError):
    pass


class TopicNotFound(LogError):
    pass


class OffsetManagementDisabled(LogError):
    pass


class TransformNotFound(LogError):
    pass


class TransformInvalid(LogError):
    pass


class TransformInvalidExports(TransformInvalid):
    """A transform module without exactly one known kind of operator."""


class TransformInitError(LogError):
    """A transform's parameters are missing or wrong."""


class ChainInitError(LogError):
    """A chain can't be built; the cause is the failing step's own error."""


class TransformRuntimeError(LogError):
    def __init__(self, hint: str, partition: int, offset: int, kind: str, key: bytes | None, value: bytes | None):
        super().__init__(f"{hint} (kind {kind}, partition {partition}, offset {offset}, key {key!r}, value {value!r})")
        self.hint, self.partition, self.offset, self.kind, self.key, self.value = hint, partition, offset, kind, key, value


class LookBackError(LogError):
    def __init__(self, hint: str, partition: int, offset: int, key: bytes | None, value: bytes | None):
        super().__init__(f"{hint} (partition {partition}, offset {offset}, key {key!r}, value {value!r})")
        self.hint, self.partition, self.offset, self.key, self.value = hint, partition, offset, key, value


class CompressionError(LogError):
    pass


class DeduplicationNotLoaded(LogError):
    pass


class DeduplicationNameInvalid(LogError):
    pass
