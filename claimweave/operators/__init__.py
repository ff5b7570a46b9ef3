"""claimweave.operators"""
