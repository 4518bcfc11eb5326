"""Sources and sinks: landing files, manifests, paged APIs, versioned tables."""
