"""A decoder for the command line's test."""


def utf16(data: bytes) -> list[str]:
    return data.decode("utf-16").split("\f")
