"""Training-data operators: ten stand-alone components over ``documents`` and ``conversations``.

Nothing outside this subpackage imports it.
"""
