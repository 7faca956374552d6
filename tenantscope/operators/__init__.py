"""DataFrame-in, DataFrame-out operators over the control plane and feeds."""
