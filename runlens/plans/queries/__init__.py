"""All registered queries; importing this package fills the registry."""

from runlens.plans.queries import (  # noqa: F401
    catalogue,
    files,
    measurements,
    merging,
    models,
    names,
    quality,
    runs,
)
