"""Nothing to stream: every operator of this engine is a batch aggregate.

Timed refresh is a batch job, see ``veritable.sources.versions``.
"""
