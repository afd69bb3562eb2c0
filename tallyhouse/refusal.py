"""The one error of the dialect: a statement that isn't answered, with a stable code."""


class Refused(Exception):
    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code
