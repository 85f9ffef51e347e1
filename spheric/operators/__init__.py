"""Operators on maps, rings, coefficients, spectra and stencils."""
