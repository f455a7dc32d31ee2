"""What can go wrong in a module call, by kind."""


class LoomError(Exception):
    """Any failure of a module, its registration or a call."""


class InvalidArgument(LoomError, ValueError):
    pass


class Unsupported(LoomError, NotImplementedError):
    pass


class InvalidState(LoomError, RuntimeError):
    pass


class Io(LoomError, OSError):
    pass


class Internal(LoomError):
    pass
