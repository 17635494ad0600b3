"""DataFrame-to-DataFrame operators; each is lazy and holds no driver-side loop over rows."""
