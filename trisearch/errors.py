"""The six kinds of failure that callers can tell apart."""


class SearchError(Exception):
    """Base of all of them."""


class NotGitRepo(SearchError):
    def __init__(self):
        super().__init__("not a git repository")


class InvalidPattern(SearchError):
    """A regular expression or glob that cannot be parsed."""


class InvalidArgument(SearchError):
    """A duration, count or option that makes no sense."""


class IndexFailure(SearchError):
    """An index that is missing, damaged or of another version."""


class LockFailure(SearchError):
    """Another build holds the index."""


class InputOutput(SearchError):
    """A file or folder that cannot be read."""
